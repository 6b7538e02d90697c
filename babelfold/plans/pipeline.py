"""End to end: pages -> tokens -> segments -> batches -> translate -> parse ->
scatter -> apply -> render, with per-page metrics.

Physical shape: one hash exchange of the page rows on ``page_id``; every
later window/aggregate/join is keyed on ``page_id`` first and reuses it.  A
Python translator is the only JVM<->Python boundary, and its responses are
checkpointed (reliable, shared folder) so side effects never run twice.

With ``distinct=True`` the batches are formed over the distinct texts of the
whole corpus instead of each page's own: a text that stands on every page is
sent once, and its answer is joined back to all of them.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from babelfold.operators import apply as A
from babelfold.operators import batching as B
from babelfold.operators.hotkeys import join_unique, key_counts
from babelfold.operators import memory as MEM
from babelfold.operators import metrics as M
from babelfold.operators import responses as R
from babelfold.operators import segments as S
from babelfold.operators import tokens as TK
from babelfold.operators import translate as TR
from babelfold.session import cut_lineage
from babelfold.sources.pages import within_size, write_pages


@dataclass
class PipelineResult:
    pages: DataFrame          # page_id, html (translated; unchanged when nothing applied), n_applied, bytes_in
    tokens: DataFrame
    segments: DataFrame
    batches: DataFrame
    responses: DataFrame
    marked: DataFrame
    translations: DataFrame
    tmap: DataFrame
    applied: DataFrame
    rejected: DataFrame       # page_id, error_class, error_message (pages handed back as they are)
    split: DataFrame | None = None  # with a memory: page_id, seq, text, translation, hit

    def unpersist(self) -> None:
        self.tokens.unpersist()


GROUP_TEXTS = 10_000  # texts that are numbered together when the corpus's distinct texts are sent


def distinct_texts(segments: DataFrame) -> DataFrame:
    """``(page_id, seq, text)`` over the distinct texts of all segments, in numbered groups
    (named ``page_id``, as for any batching) of about GROUP_TEXTS texts.

    The texts are written once: their number decides the number of groups."""
    texts = cut_lineage(key_counts(segments, "text").select("text"))
    groups = max(1, -(-texts.count() // GROUP_TEXTS))
    w = Window.partitionBy("page_id").orderBy("text")
    return (texts.withColumn("page_id", F.pmod(F.xxhash64("text"), F.lit(groups)).cast("long"))
            .select("page_id", (F.row_number().over(w) - 1).cast("long").alias("seq"), "text"))


def translate_pages(pages: DataFrame, translator=None, concurrent: int = B.DEFAULT_CONCURRENT_BATCHES,
                    batch_size: int | None = None, iframe_mode: str = "off", escape_newlines: bool = False,
                    max_parallel: int | None = None, max_page_bytes: int | None = None,
                    num_partitions: int | None = None, checkpoint_responses: bool | None = None,
                    persist: bool = False, memory: DataFrame | None = None,
                    lang: str = B.DEFAULT_TARGET_LANG, distinct: bool = False, rounds: int = 1,
                    in_flight: int = B.DEFAULT_CONCURRENT_BATCHES, timeout_s: float | None = TR.CALL_TIMEOUT_S,
                    observed: dict[str, Observation] | None = None) -> PipelineResult:
    """Translate every page.

    ``distinct`` sends every distinct text of the corpus once (see the module
    text; ``batch_size`` is then DEFAULT_BATCH_SIZE unless given), ``rounds``
    re-sends failed batches, ``in_flight`` and ``timeout_s`` bound the calls of a
    task.  Rows of a page id that occurs before, and rows without one, can't be
    told apart by it: they are reported and come back as they are.

    Plan: one exchange of the pages on ``page_id``; extraction, batching,
    translation, the map and rendering all reuse it (no cache is needed: the
    map is built from the responses, and rendering re-tokenises without the
    depth window).  ``persist=True`` keeps the tokens instead (one tokenising
    pass, at the cost of cache storage and exchanges after the cache)."""
    B.check_lang(lang)
    translator = translator or TR.prefix(lang)
    src = pages.select("page_id", "html")
    # the one exchange; every branch below reads it unfiltered, so it is shared
    once = TK.first_of_each(TK.partition_pages(src, num_partitions))
    part = once.filter("copy = 1").select("page_id", "html")
    # report view only (lazy): pages that are passed through untouched for input reasons
    too_big = ~F.coalesce(within_size(F.col("html"), max_page_bytes), F.lit(True)) if max_page_bytes else F.lit(False)
    reason = (F.when(F.col("page_id").isNull(), F.lit("page_id is NULL")).when(F.col("copy") > 1, F.lit("page_id occurs before"))
              .otherwise(F.lit(f"page over {max_page_bytes} bytes")))
    rejected = once.unionByName(src.filter(F.col("page_id").isNull()).withColumn("copy", F.lit(1))).filter(
        too_big | F.col("page_id").isNull() | (F.col("copy") > 1)).select(
        "page_id", F.lit("input").alias("error_class"), reason.alias("error_message"))
    tokens = TK.tokenize(part, max_bytes=max_page_bytes)
    if persist:
        tokens = tokens.persist(StorageLevel.MEMORY_AND_DISK)
    segments = S.extract_segments(tokens, iframe_mode, observed)
    if observed:
        # written once, so that each text is counted once, whatever reads the segments
        segments = cut_lineage(segments.observe(observed["kept"], F.count(F.lit(1)).alias("texts_kept")))
    hits = split = None
    to_send = segments
    if memory is not None:
        # translation memory: texts already translated are not sent again.  The
        # memory is probed once per distinct text (a hot text costs one probe);
        # the misses are renumbered densely per page for the requests.  The answer is
        # read three times (hits, misses, report): it is written once, so the pages are
        # taken apart once.
        if not observed:
            # the split reads the segments for its counts, its probe and its join
            segments = cut_lineage(segments)
        split = MEM.tm_split(segments.select("page_id", "seq", "text"), memory, lang)
        if observed:
            split = split.observe(observed["memory"], F.count_if("hit").alias("n_hits"), F.count_if(~F.col("hit")).alias("n_misses"))
        split = cut_lineage(split)
        hits = split.filter("hit").select("page_id", "text", "translation")
        miss = split.filter("NOT hit").select("page_id", "seq", "text")
        w = Window.partitionBy("page_id").orderBy("seq")
        to_send = miss.withColumn("seq", (F.row_number().over(w) - 1).cast("long"))
    if distinct:
        to_send = cut_lineage(to_send.select("page_id", "seq", "text")) if memory is None else to_send
        planned = B.plan_batches(distinct_texts(to_send), size=batch_size or B.DEFAULT_BATCH_SIZE)
    else:
        planned = B.plan_batches(to_send, concurrent, batch_size)
    batches = B.build_payload(planned, escape_newlines)
    call = {"max_parallel": max_parallel, "lang": lang, "in_flight": in_flight, "timeout_s": timeout_s}
    if rounds > 1:
        responses = TR.translate_with_resends(batches, translator, rounds, **call).drop("round")
    else:
        responses = TR.translate_batches(batches, translator, **call)
    if observed:
        responses = responses.observe(observed["sent"], F.count(F.lit(1)).alias("n_batches"), F.count("error_class").alias("n_failed_batches"))
    if observed or checkpoint_responses or (checkpoint_responses is None and isinstance(translator, TR.PythonTranslator)):
        responses = cut_lineage(responses)
    # the map comes from the responses alone (each batch carries its items):
    # no second read of the segments, one aggregate keyed (page_id, seq)
    full = R.translation_map_from_responses(responses)
    if distinct:
        # one answer per text, handed to every page that holds it
        answers = full.filter(F.col("text").isNotNull() & F.col("translation").isNotNull()).select("text", "translation")
        full = join_unique(to_send.select("page_id", "seq", "text"), answers, "text")
    tmap = full.filter(F.col("text").isNotNull() & F.col("translation").isNotNull()).select(
        "page_id", "text", "translation")
    if hits is not None:
        tmap = tmap.unionByName(hits)
    # rendering re-reads the partitioned pages: tokens without the depth window
    render_tokens = tokens if persist else TK.tokenize(part, with_level=False, max_bytes=max_page_bytes)
    applied = A.applied_pieces(render_tokens, tmap)
    rendered = A.render(applied)
    # every page (NULL/empty/oversized ones as a single 'whole' token) is rendered
    out = rendered.select("page_id", "html", "n_applied", "bytes_in")
    # pages that can't be addressed: reported, and handed back as they are
    nameless = once.filter("copy > 1").select("page_id", "html").unionByName(src.filter(F.col("page_id").isNull())).select(
        "page_id", "html", F.lit(0).cast(out.schema["n_applied"].dataType).alias("n_applied"),
        F.octet_length("html").cast(out.schema["bytes_in"].dataType).alias("bytes_in"))
    out = out.unionByName(nameless)
    # stage views for reports (lazy; not on the path of ``pages``)
    ok_resp = responses.filter(F.col("error_class").isNull()).select(
        "page_id", "batch_idx", "n", R.unwrap_response(F.col("response")).alias("text"))
    marked = R.parse_markers(ok_resp)
    translations = full.filter(F.col("translation").isNotNull()).select("page_id", "seq", "translation")
    return PipelineResult(out, tokens, segments, batches, responses, marked, translations, tmap, applied, rejected, split)


def translate_to(pages: DataFrame, path: str, lang: str = B.DEFAULT_TARGET_LANG, **options) -> DataFrame:
    """Translates ``pages`` into a table under ``path`` (one folder per language) and
    returns the run's report, one row.

    The counts are observed by the jobs that do the work anyway: the one that takes
    the pages apart, the one that sends the batches and the one that writes the
    pages.  Nothing is computed a second time for the report.
    """
    spark = pages.sparkSession
    began = time.monotonic()
    seen = {k: Observation(k) for k in ("candidates", "kept", "sent", "out", "memory") if k != "memory" or options.get("memory") is not None}
    res = translate_pages(pages, lang=lang, observed=seen, **options)
    out = res.pages.observe(seen["out"], F.count(F.lit(1)).alias("n_pages"), F.sum("bytes_in").alias("bytes_in"),
                            F.sum(F.octet_length("html")).alias("bytes_out"), F.sum("n_applied").alias("n_applied"))
    write_pages(out.select("page_id", "html", "n_applied", F.lit(lang).alias("lang")), path)
    counts: dict = {}
    for o in seen.values():
        counts |= o.get
    return M.run_report(spark, counts, round(1000 * (time.monotonic() - began)))
