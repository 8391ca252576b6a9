"""Personal data: fixed formats first, then bootstrapped contextual extraction.

E-mail addresses, IP addresses, card and phone numbers of fixed formats are the
seeds. The words around a seed are its lexical patterns; other tokens with a digit
or an at sign that stand in the same patterns are candidates. Patterns and instances
form a graph that is scored in rounds: a pattern's confidence for a kind is the mean
reliability of the distinct instances in it (unknown candidates count as zero), an
instance's reliability is what its confident patterns say together. Candidates that
become reliable are identifiers that no format describes; they count as known in the
next round.

Everything is DataFrame functions. The text is scanned once; the graph has one row
per pattern and instance, however often they occur.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.llm.common import WHITE, broadcast_if_small, let, same, text_of
from assetloom.session import materialize

# fixed values: the kinds in their order
KINDS = ("email", "ip", "card", "phone")
# The formats. A match starts where the last one ended or where its first run of characters
# starts (an earlier start would fail at the same place), and runs never give characters back:
# the matches are those of the plain expressions, in linear time.
FORMATS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# what a text needs for a match; a cheap test
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
CONTEXT_CHARS = 64
CHUNK = 64
BLOCK_CHARS = 4096
OUTPUTS = ("spans", "base_spans")


@dataclass(frozen=True)
class Settings:
    """Thresholds of the bootstrapping."""

    rounds: int = 3
    pattern_confidence: float = 0.8
    pattern_support: int = 3  # distinct known instances a pattern needs
    instance_reliability: float = 0.8


def _prefix_sums(sizes: Column) -> Column:
    """For every element the sum of those before it; sums of chunks keep long arrays near linear."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda s, x: s + x)

    def offsets(chunks: Column) -> Column:
        # one more than there are chunks; chunks are few
        return F.aggregate(
            chunks, F.array(F.lit(0)), lambda out, x: F.concat(out, F.array(F.element_at(out, -1) + x))
        )

    def before(i: Column, chunk_offsets: Column) -> Column:
        chunk = F.floor(i / CHUNK).cast("int")
        return F.element_at(chunk_offsets, chunk + 1) + total(F.slice(sizes, chunk * CHUNK + 1, i % CHUNK))

    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK).cast("int")),
        lambda c: total(F.slice(sizes, c * CHUNK + 1, F.lit(CHUNK))),
    )
    return let(offsets(chunks), lambda o: F.transform(sizes, lambda x, i: before(i, o)))


def _located(text: Column, regex: str) -> Column:
    """Matches of a regex as structs (start, end, surface), in code points."""
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))

    def spans(hits: Column, gaps: Column, starts: Column) -> Column:
        return F.transform(
            F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.size(hits)).alias("gap"), starts.alias("at")),
            lambda x: F.struct(
                (x["at"] + F.char_length(x["gap"])).alias("start"),
                (x["at"] + F.char_length(x["gap"]) + F.char_length(x["hit"])).alias("end"),
                x["hit"].alias("surface"),
            ),
        )

    def walk(hits: Column) -> Column:
        return let(
            F.split(text, regex),
            lambda gaps: let(
                F.zip_with(
                    hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.char_length(h) + F.char_length(g)
                ),
                lambda sizes: spans(hits, gaps, _prefix_sums(sizes)),
            ),
        )

    none = F.array().cast("array<struct<start:int,end:int,surface:string>>")
    return let(found, lambda hits: F.when(F.size(hits) > 0, walk(hits)).otherwise(none))


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    back = F.reverse(digits)

    def term(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + term(i))
    return total % 10 == 0


def _valid(kind: str, surface: Column) -> Column:
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (
            F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255
        )
        return F.forall(F.split(surface, r"\."), small)
    digits = F.regexp_replace(surface, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans of the fixed formats: array of (start, kind, end, surface), kind as a number, in order."""
    return F.array_sort(F.concat(*[_base_of_kind(text, k, kind) for k, kind in enumerate(KINDS)]))


def _base_of_kind(text: Column, number: int, kind: str) -> Column:
    found = _located(text, FORMATS[kind])
    if kind in NEEDS:
        found = F.when(text.contains(NEEDS[kind]), found)
    spans = F.transform(
        F.filter(found, lambda x: _valid(kind, x["surface"])),
        lambda x: F.struct(
            x["start"].alias("start"),
            F.lit(number).alias("kind"),
            x["end"].alias("end"),
            x["surface"].alias("surface"),
        ),
    )
    return F.coalesce(spans, F.array().cast("array<struct<start:int,kind:int,end:int,surface:string>>"))


def _candidates(text: Column, base: Column) -> Column:
    """Tokens with a digit or an at sign outside all base spans, without punctuation at their ends."""
    edge = r"^[^A-Za-z0-9+@]+|[^A-Za-z0-9]+$"
    trimmed = F.transform(
        _located(text, TOKEN),
        lambda x: F.struct(
            (
                x["start"] + F.char_length(x["surface"]) - F.char_length(F.regexp_replace(x["surface"], r"^[^A-Za-z0-9+@]+", ""))
            ).alias("start"),
            F.regexp_replace(x["surface"], edge, "").alias("surface"),
        ),
    )
    sized = F.transform(
        trimmed,
        lambda x: F.struct(
            x["start"].alias("start"),
            F.lit(None).cast("int").alias("kind"),
            (x["start"] + F.char_length(x["surface"])).alias("end"),
            x["surface"].alias("surface"),
        ),
    )
    return F.filter(
        sized,
        lambda x: (F.char_length(x["surface"]) > 0)
        & ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])),
    )


def _with_context(text: Column, spans: Column) -> Column:
    """Spans with their lexical patterns: two words before; one before and one after."""

    # overlapping blocks: a substring then never walks over more than one block
    count = F.floor(F.char_length(text) / BLOCK_CHARS).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), count),
        lambda k: F.substring(text, k * BLOCK_CHARS + 1, F.lit(BLOCK_CHARS + CONTEXT_CHARS)),
    )
    return let(blocks, lambda b: F.transform(spans, lambda x: let(_around(b, x), lambda c: _patterns(x, c))))


def _around(blocks: Column, span: Column) -> Column:
    """The characters before and after a span."""

    def piece(at: Column, size: Column) -> Column:
        block = F.floor(at / BLOCK_CHARS).cast("int")
        return F.lower(F.substring(F.element_at(blocks, block + 1), at % BLOCK_CHARS + 1, size))

    low = F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0))
    return F.struct(
        F.split(F.btrim(piece(low, span["start"] - low), F.lit(WHITE)), r"\s++").alias("before"),
        F.regexp_extract(piece(span["end"], F.lit(CONTEXT_CHARS)), r"^\S*+\s++(\S++)", 1).alias("right"),
    )


def _patterns(x: Column, around: Column) -> Column:
    before, right = around["before"], around["right"]
    one = F.element_at(before, -1)
    two = F.when(F.size(before) > 1, F.array_join(F.slice(before, -2, 2), " "))
    return F.struct(
        x["start"].alias("start"),
        x["kind"].alias("kind"),
        x["end"].alias("end"),
        F.lower(x["surface"]).alias("surface"),
        F.filter(
            F.array(
                F.when(two.isNotNull(), F.concat(F.lit("2 "), two)),
                F.when(one != "", F.concat(F.lit("1 "), one)),
                F.when((one != "") & (right != ""), F.concat_ws(" ", F.lit("a"), one, F.lit("_"), right)),
            ),
            lambda p: p.isNotNull(),
        ).alias("patterns"),
    )


def bootstrap(occurrences: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Reliable unknown instances (surface, kind) from occurrences (surface, kind or NULL, patterns)."""
    s = settings
    edges = materialize(
        occurrences.select("surface", "kind", F.explode("patterns").alias("pattern"))
        .groupBy("pattern", "surface")
        .agg(F.max("kind").alias("kind"))
    )
    known = materialize(
        edges.where(F.col("kind").isNotNull())
        .groupBy("surface", "kind")
        .agg(F.lit(1.0).alias("reliability"))
    )
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances"))
    found = known.where(F.lit(False)).select("surface", "kind")
    for _ in range(s.rounds):
        scores = (
            edges.select("pattern", "surface")
            .join(known, "surface")
            .groupBy("pattern", "kind")
            .agg(F.sum("reliability").alias("mass"), F.count(F.lit(1)).alias("support"))
            .where(F.col("support") >= s.pattern_support)
            .join(sizes, "pattern")
            .withColumn("confidence", F.col("mass") / F.col("instances"))
            .where(F.col("confidence") >= s.pattern_confidence)
            .select("pattern", "kind", "confidence")
        )
        # patterns speak independently; a pattern of confidence 1 has no unknown instance
        told = (
            edges.where(F.col("kind").isNull())
            .select("pattern", "surface")
            .join(scores, "pattern")
            .groupBy("surface", "kind")
            .agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("reliability"))
            .where(F.col("reliability") >= s.instance_reliability)
        )
        best = told.groupBy("surface").agg(F.max_by(F.struct("kind", "reliability"), F.struct("reliability", -F.col("kind"))).alias("best"))
        found = materialize(best.select("surface", "best.kind", "best.reliability"))
        seeds = edges.where(F.col("kind").isNotNull()).groupBy("surface", "kind").agg(F.lit(1.0).alias("reliability"))
        known = materialize(seeds.unionByName(found))
    return found.select("surface", "kind")


def find_personal_data(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", settings: Settings = Settings()
) -> DataFrame:
    """All rows of ``docs`` with ``base_spans`` and ``spans`` added.

    Both are arrays of (start, kind, end): code points, end exclusive, kind an index
    into ``KINDS``, ordered by start and kind. ``base_spans`` are the fixed formats,
    ``spans`` these and the discovered identifiers.

    NULL and empty texts have no spans. Rows are judged alike wherever they repeat;
    repeated rows add no evidence, as instances count once per pattern. An empty table
    gives an empty result. Columns that bear an output's name are replaced.
    """
    digest = F.xxhash64(text_of(text_col))
    entry = "array<struct<start:int,kind:int,end:int>>"
    scanned = docs.select(
        F.col(f"`{id_col}`").alias("id"), digest.alias("digest"), text_of(text_col).alias("text")
    ).where(F.col("text").rlike("[0-9@]"))
    text = F.col("text")
    every = let(base_spans(text), lambda base: F.concat(base, _candidates(text, base)))
    scanned = materialize(scanned.select("id", "digest", _with_context(text, every).alias("all")))
    scanned = scanned.where(F.size("all") > 0)
    occurrences = scanned.select("id", "digest", F.inline("all"))
    found = bootstrap(occurrences, settings).withColumnRenamed("kind", "told")
    more = (
        occurrences.where(F.col("kind").isNull())
        .join(found, "surface")
        .groupBy("id", "digest")
        .agg(F.collect_set(F.struct("start", F.col("told").alias("kind"), "end")).alias("more"))
        .select(F.col("id").alias("more_id"), F.col("digest").alias("more_digest"), "more")
    )
    base = F.transform(
        F.filter("all", lambda x: x["kind"].isNotNull()),
        lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")),
    )
    spans = scanned.select("id", "digest", base.cast(entry).alias("base")).dropDuplicates(["id", "digest"])
    spans = spans.join(more, same(spans, more, {"id": "more_id", "digest": "more_digest"}), "left").select(
        F.col("id").alias("_llm_id"),
        F.col("digest").alias("_llm_digest"),
        F.col("base").alias("_llm_base"),
        F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(entry)))).alias("_llm_all"),
    )
    spans = broadcast_if_small(materialize(spans), F.size("_llm_all") * 48 + 64)
    kept = docs.drop(*[c for c in OUTPUTS if c not in (text_col, id_col)])
    names = kept.columns
    kept = kept.withColumn("_llm_own", digest)
    out = kept.join(spans, same(kept, spans, {id_col: "_llm_id", "_llm_own": "_llm_digest"}), "left")
    none = F.array().cast(entry)
    return out.select(
        *[F.col(f"`{c}`") for c in names],
        F.coalesce("_llm_base", none).alias("base_spans"),
        F.coalesce("_llm_all", none).alias("spans"),
    )


def spans_text(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )
