"""Personal data by bootstrapped contextual extraction, in native Spark functions.

1. Seeds: e-mail addresses, IP addresses, card and phone numbers by their form,
   with code-point spans.  A text is cut at the matches of a pattern; running
   sums of the pieces' lengths are the spans.
2. Candidates: the other words that hold a digit or an @.
3. Seeds and candidates have lexical patterns: the word before, the two words
   before, and the words around.  Patterns and values form a graph.
4. Rounds over the graph: a pattern is accepted for a kind if enough of its
   distinct values, and the share ``confidence`` of all of them, are seeds of
   the kind or were accepted as such in an earlier round, so through other
   patterns.  All values of an accepted pattern are accepted for the next
   round.  What the graph gathers grows with the corpus; every step is an
   aggregate with map-side partials, or a join of two written tables, so that a
   pattern with a third of all values is split.
5. Candidates become spans of their kind where a pattern of their own place is
   accepted; the same value elsewhere does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import cut, small

# fixed values: the kinds in order, and their forms.  Possessive runs and the
# anchors at run starts change no match; they keep long runs linear.
KINDS = ("email", "ip", "card", "phone")
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
MARK, MASK = "\x01", "\x02"
ROUNDS, MIN_SEEDS, CONFIDENCE = 3, 8, 0.9


def _pieces(text: Column, form: str) -> Column:
    """The text cut at the matches: odd pieces are matches."""
    return F.split(F.regexp_replace(text, f"({form})", f"{MARK}$1{MARK}"), MARK)


def _valid(kind: str, x: str) -> str:
    """Whether a match of a kind counts, as SQL over the expression ``x``."""
    digits = f"regexp_replace({x}, '[^0-9]', '')"
    if kind == "ip":
        return f"forall(split({x}, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)"
    if kind == "card":
        double = f"cast(substring('0246813579', cast(substring({digits}, k, 1) as int) + 1, 1) as int)"
        luhn = (f"aggregate(sequence(1, length({digits})), 0, (s, k) -> s + case when (length({digits}) - k) % 2 = 0 "
                f"then cast(substring({digits}, k, 1) as int) else {double} end) % 10 = 0")
        return f"case when length({digits}) between 13 and 19 then {luhn} else false end"
    return f"length({digits}) between 9 and 15" if kind == "phone" else "true"


VALID = "case kind " + " ".join(f"when '{k}' then {_valid(k, 'value')}" for k in KINDS) + " else true end"


def _ends(kind: str) -> Column:
    """(kind, i, len, value, tail, head) of each piece: a match's text, and the
    two words (of 200 characters at most) that end a piece between matches or begin it."""
    def piece(x, i):
        tail = F.regexp_extract(F.right(x, F.lit(200)), r"([^\x20\x09-\x0D]*+[\x20\x09-\x0D]*+[^\x20\x09-\x0D]+[\x20\x09-\x0D]*)$", 1)
        head = F.regexp_extract(F.substring(x, 1, 200), r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)", 1)
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x).alias("len"), F.when(i % 2 == 1, x).alias("value"),
                        F.when(i % 2 == 0, F.lower(tail)).alias("tail"), F.when(i % 2 == 0, F.lower(head)).alias("head"))
    return F.transform(F.col(kind), piece)


def _is(kind: str):
    return lambda x: x["kind"] == kind


def _matches(docs: DataFrame) -> DataFrame:
    """Seeds and candidates ``(row, doc_id, kind, start, end, value, before, after)`` of
    ``docs(row, doc_id, text)``, and one row of kind null for every document."""
    t = docs.withColumn("t", F.translate(F.coalesce("text", F.lit("")), MARK + MASK, "\x03\x03"))
    for k in KINDS:
        none = F.array(F.col("t"))
        cut_ = _pieces(F.col("t"), FORMS[k])
        t = t.withColumn(k, F.when(F.contains("t", F.lit("@")), cut_).otherwise(none) if k == "email" else cut_)
    # what a seed covers is no candidate
    t = t.withColumn("hidden", F.col("t"))
    for k in ("phone", "email", "ip", "card"):  # a form that can hold another comes first
        t = t.withColumn("p", _pieces(F.col("hidden"), FORMS[k])).withColumn("hidden", F.expr(
            f"array_join(transform(p, (x, i) -> case when i % 2 = 1 and {_valid(k, 'x')} then repeat('{MASK}', length(x)) else x end), '')"))
    hidden = F.col("hidden")
    any_digit = F.col("t").rlike("[0-9@]")
    t = t.withColumn("word", F.when(any_digit, _pieces(hidden, CANDIDATE)).otherwise(F.array(F.col("t"))))
    # of the pieces between matches only the length and the words at either end go on
    ends = [_ends(k) for k in (*KINDS, "word")]
    some = F.flatten(F.array(*[F.when(F.size(k) > 1, e).otherwise(F.slice(e, 1, 0)) for k, e in zip((*KINDS, "word"), ends)]))
    none = F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("len"),
                            *[F.lit(None).cast("string").alias(c) for c in ("value", "tail", "head")]))
    return t.select("row", "doc_id", F.explode(F.concat(none, some)).alias("m")).select("row", "doc_id", "m.*")


def find_spans(docs: DataFrame, min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, base, found)`` for every row of ``docs(doc_id, text)``: two arrays
    of ``(kind, start, end, value)`` ordered by kind and start, of the seeds and
    of what the contexts discover.

    Starts and ends are code points, the end excluded.  A null or empty text
    has none.  Repeated rows are answered each, null ids too.  An empty table
    gives no rows.  Other columns are ignored.
    """
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col("text").cast("string").alias("text"))
    raw = cut(_matches(src))
    w = "partition by row, kind order by i"
    seen = raw.select(
        "row", "doc_id", "kind", "i", "value", "len",
        F.expr(f"sum(len) over ({w}) - len").alias("start"),
        F.expr(f"lag(tail) over ({w})").alias("before"), F.expr(f"lead(head) over ({w})").alias("after"))
    seen = seen.filter("i % 2 = 1 or kind is null").withColumn("ok", F.expr(VALID))
    # a candidate's closing punctuation isn't part of it
    value = F.when(F.col("kind") == "word", F.regexp_replace("value", r"[.,;:!?\)\]\"']+$", "")).otherwise(F.col("value"))
    hits = cut(seen.filter("ok or kind is null").withColumn("value", value).filter("kind is null or length(value) > 0").select(
        "row", "doc_id", "kind", F.col("start").cast("long").alias("start"),
        (F.col("start") + F.length("value")).cast("long").alias("end"), "value", "before", "after"))

    two = F.filter(F.split(F.trim(F.regexp_replace("before", r"[\x20\x09-\x0D]+", " ")), " "), lambda x: x != "")
    two = F.transform(two, lambda x: F.regexp_replace(x, "[0-9]", "9"))
    one = F.element_at(two, -1)
    after = F.regexp_replace("after", "[0-9]", "9")
    named = F.array(F.concat(F.lit("1 "), one), F.when(F.size(two) > 1, F.concat_ws(" ", F.lit("2"), two)),
                    F.concat(F.lit("3 "), one, F.lit(" _ "), after))
    placed = hits.filter("kind is not null").withColumn("two", two).filter(F.size("two") > 0).select(
        "row", "start", F.lower("value").alias("value"), "kind", F.explode(F.filter(named, lambda x: x.isNotNull())).alias("pattern"))
    edges = placed.groupBy("pattern", "value").agg(F.max(F.when(F.col("kind") != "word", F.col("kind"))).alias("seed"))
    # a pattern of too few values, or without a candidate, has no part in it in any round
    total = cut(edges.groupBy("pattern").agg(F.count("seed").alias("seeds"), F.count(F.lit(1)).alias("n")).filter(
        (F.col("n") >= min_seeds) & (F.col("n") > F.col("seeds"))).select("pattern", "n"))
    edges = cut(edges.join(small(total), "pattern"))
    seeds = cut(edges.filter("seed is not null").select("value", F.col("seed").alias("kind")).distinct())
    known, many, rated = seeds, -1, None
    for _ in range(rounds):
        gained = edges.select("pattern", "n", "value").join(small(known), "value").groupBy("pattern", "kind").agg(
            F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
        rated = cut(gained.filter((F.col("c") >= min_seeds) & (F.col("c") / F.col("n") >= confidence)).select(
            "pattern", F.col("kind").alias("as_kind"), (F.col("c") / F.col("n")).alias("r")))
        was, many = many, rated.count()
        if many in (0, was):  # patterns stay accepted, so the same number is the same set
            break
        passed = edges.filter("seed is null").join(small(rated), "pattern").select("value", F.col("as_kind").alias("kind"))
        known = cut(seeds.union(passed.distinct()))
    best = placed.filter("kind = 'word'").join(small(rated), "pattern").groupBy("row", "start").agg(
        F.max(F.struct("r", "as_kind")).alias("b")).select("row", "start", F.lit("word").alias("kind"), F.col("b.as_kind").alias("as_kind"))
    out = hits.join(small(cut(best)), ["row", "start", "kind"], "left")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("k")).cast("int")
    base = F.col("kind").isNotNull() & (F.col("kind") != "word")
    span = F.struct("rank", "start", "end", F.col("k").alias("kind"), "value")
    out = out.withColumn("k", F.when(base, F.col("kind")).otherwise(F.col("as_kind"))).withColumn("rank", rank)

    def spans(which):
        return F.transform(F.array_sort(F.collect_list(F.when(which & F.col("k").isNotNull(), span))),
                           lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))
    out = out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), spans(base).alias("base"), spans(F.col("kind") == "word").alias("found"))
    # a candidate that a seed overlaps (one form inside another) adds nothing
    apart = F.expr("filter(found, f -> not exists(base, b -> f.start < b.end and b.start < f.end))")
    return out.select("doc_id", "base", F.when(F.size("found") > 0, apart).otherwise(F.col("found")).alias("found"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns of :func:`find_spans`."""
    count = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    both = F.concat("base", "found")
    rank = F.transform(both, lambda x: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("r"),
                                                x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return found.select("doc_id", *count, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(rank)).alias("spans"))
