"""Personal data and the words that give it away; DataFrame functions only.

Base spans come from four patterns. Around them, an information-theoretic measure decides which
words must go too: a term reveals an entity when the corpus says that seeing the term gives most of
the information that the entity itself carries, PMI(term; entity) >= share * IC(entity), with
PMI = log(N n_te / (n_t n_e)) and IC = log(N / n_e) over document counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.llm.store import kept

# The patterns of the contract in a form that reads a text once: a run is entered at its first
# character only (every later start would end at the same place), and no repetition backtracks.
# Digit counts of cards are part of the pattern; a longer or shorter run is one failing match.
KINDS = {
    "email": r"(?:\G(?!^)|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
BLOCK = 256
_PART = "^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"


@dataclass(frozen=True)
class PrivacyParameters:
    """``reach``: code points of context on either side; ``support``: distinct texts that must show a
    term beside an entity; ``share``: part of the entity's information that a term may not give."""

    reach: int = 60
    support: int = 3
    share: float = 0.9
    term: str = r"\p{L}{3,}"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    def weigh(c: Column, i: Column) -> Column:
        twice = F.coalesce(c.try_cast("int"), F.lit(0)) * (i % 2 + 1)  # the split ends in an empty string
        return F.when(twice > 9, twice - 9).otherwise(twice)

    each = F.transform(F.split(F.reverse(_digits(match)), "(?!^)"), weigh)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda p: p.rlike(_PART)),
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def _placed(gaps: str, matches: str) -> Column:
    """(start, end, value) of matches, from the pieces between them, in code points.

    Offsets are sums within blocks of 256 matches and over whole blocks before, so a text of very
    many matches costs less than the square of their number.
    """
    sizes = F.transform(
        F.arrays_zip(F.col(gaps).alias("g"), F.col(matches).alias("m")),
        lambda z: F.length(z["g"]) + F.coalesce(F.length(z["m"]), F.lit(0)),
    )

    def total(array: Column) -> Column:
        return F.aggregate(array, F.lit(0), lambda a, x: a + x)

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(matches) / BLOCK).cast("int")),
        lambda b: total(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))),
    )

    def place(m: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        start = (
            total(F.slice(blocks, F.lit(1), block))
            + total(F.slice(sizes, block * BLOCK + 1, i % BLOCK))
            + F.length(F.get(F.col(gaps), i))
        )
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"))

    return F.transform(F.col(matches), place)


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text, base): the valid base matches as an array of (start, rank, end, kind, value), ordered."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id",
        "text",
        *[F.regexp_extract_all("text", F.lit(p), 0).alias(f"{k}_m") for k, p in KINDS.items()],
        *[
            F.when(F.col("text").rlike(p), F.split("text", p, -1)).otherwise(F.array().cast("array<string>")).alias(f"{k}_g")
            for k, p in KINDS.items()
        ],
    )
    placed = rows.select("doc_id", "text", *[_kind_spans(k).alias(k) for k in KINDS])
    return placed.select("doc_id", "text", F.array_sort(F.concat(*KINDS)).alias("base"))


def _kind_spans(kind: str) -> Column:
    valid, rank = _VALID[kind], list(KINDS).index(kind)
    return F.transform(
        F.filter(_placed(f"{kind}_g", f"{kind}_m"), lambda s: valid(s["value"])),
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"),
            F.lit(kind).alias("kind"), s["value"].alias("value"),
        ),
    )


def _context(found: DataFrame, p: PrivacyParameters) -> DataFrame:
    """(row, page, entity, term, start, end): whole words within reach of each base span."""
    spans = found.filter(F.size("base") > 0).select("row", "text", "page", F.explode("base").alias("s"))
    low = F.greatest(F.col("s.start") - p.reach, F.lit(0))
    left = F.col("text").substr(low + 1, F.col("s.start") - low)
    right = F.col("text").substr(F.col("s.end") + 1, F.lit(p.reach))
    # A word cut by the edge of the window is no term.
    cut_left = F.when(low > 0, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left)
    far = F.col("s.end") + p.reach < F.length("text")
    cut_right = F.when(far, F.regexp_replace(right, r"\p{L}+$", "")).otherwise(right)
    sides = spans.select(
        "row", "page",
        F.concat(F.col("s.kind"), F.lit(":"), F.lower("s.value")).alias("entity"),
        F.explode(F.array(
            F.struct((F.col("s.start") - F.length(cut_left)).alias("at"), cut_left.alias("side")),
            F.struct(F.col("s.end").alias("at"), cut_right.alias("side")),
        )).alias("c"),
    ).select(
        "row", "page", "entity", F.col("c.at").alias("at"),
        F.regexp_extract_all("c.side", F.lit(p.term), 0).alias("words"),
        F.split("c.side", p.term, -1).alias("gaps"),
    )
    return sides.select(
        "row", "page", "entity", "at", F.explode(_placed("gaps", "words")).alias("w")
    ).select(
        "row", "page", "entity", F.lower("w.value").alias("term"),
        (F.col("at") + F.col("w.start")).alias("start"), (F.col("at") + F.col("w.end")).alias("end"),
    )


def disclosures(docs: DataFrame, context: DataFrame, p: PrivacyParameters) -> DataFrame:
    """(entity, term, given): terms that reveal an entity, with the share of its information they give."""
    pairs = (
        context.groupBy("entity", "term")
        .agg(F.count_distinct("row").alias("n_te"), F.count_distinct("page").alias("pages"))
        .filter(F.col("pages") >= p.support)
    )
    entities = context.select("entity", "row").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(p.term), 0))
    terms = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    measured = pairs.join(entities, "entity").join(terms, "term").join(F.broadcast(total))  # one row
    pmi = F.log(F.col("n") * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    return measured.withColumn("given", pmi / F.log(F.col("n") / F.col("n_e"))).filter(
        (F.col("n") > F.col("n_e")) & (F.col("given") >= p.share)
    ).select("entity", "term", "given")


def protected_spans(docs: DataFrame, p: PrivacyParameters | None = None) -> DataFrame:
    """(doc_id, page, base, terms): base spans, and (start, end, given) of words near them that reveal them.

    Words that overlap a base span are left to it. Null texts count as empty; other columns are
    ignored. Rows of one doc_id, or of none, are documents of their own. ``page`` is a hash of the
    text; rows of equal texts have equal spans.
    """
    p = p or PrivacyParameters()
    docs = docs.select("doc_id", "text")
    base = base_spans(docs)
    found = kept(
        base.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("page"), "base",
            F.when(F.size("base") > 0, F.col("text")).alias("text"),
        ),
        "privacy-base",
    )
    context = kept(_context(found, p), "privacy-context")
    terms = (
        context.join(disclosures(docs, context, p), ["entity", "term"])
        .groupBy("row", "start", "end").agg(F.max("given").alias("given"))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "given"))).alias("terms"))
    )
    clear = F.filter(
        "terms", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    )
    return found.join(terms, "row", "left").select(
        "doc_id", "page", "base",
        F.coalesce(clear, F.array().cast("array<struct<start:int,end:int,given:double>>")).alias("terms"),
    )


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")


def report(docs: DataFrame, p: PrivacyParameters | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term per document."""
    found = protected_spans(docs, p)
    terms = F.transform("terms", lambda t: F.struct(
        t["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), t["end"].alias("end"),
        F.lit("term").alias("kind"), F.lit("").alias("value"),
    ))
    return found.select(
        "doc_id",
        *[_count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", terms))).alias("spans"),
        F.size("terms").cast("bigint").alias("n_term"),
    )


def sanitised(docs: DataFrame, p: PrivacyParameters | None = None) -> DataFrame:
    """The documents, same columns, with base spans as <kind> and revealing words generalised or removed.

    A word that gives all of an entity's information is removed; one that gives less becomes <word>.
    Of overlapping base spans the first, then the longest, is named and the rest of the others cut.
    doc_id may be null or repeated: a row is known by its text.
    """
    found = protected_spans(docs, p).dropDuplicates(["page"]).select(
        F.col("page").alias("_page"),
        F.array_sort(F.concat(
            F.transform("base", lambda s: F.struct(
                s["start"].alias("start"), (-s["end"]).alias("back"), s["end"].alias("end"),
                F.concat(F.lit("<"), s["kind"], F.lit(">")).alias("tag"))),
            F.transform("terms", lambda t: F.struct(
                t["start"].alias("start"), (-t["end"]).alias("back"), t["end"].alias("end"),
                F.when(t["given"] >= 1.0, F.lit("")).otherwise(F.lit("<word>")).alias("tag"))),
        )).alias("_cuts"),
    )
    text = F.col("text")

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        piece = F.concat(text.substr(a["at"] + 1, s["start"] - a["at"]), s["tag"])
        return F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(a["out"], piece)).otherwise(a["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(
        "_cuts", start, step, lambda a: F.concat(a["out"], text.substr(a["at"] + 1, F.length(text)))
    )
    joined = docs.join(found.filter(F.size("_cuts") > 0), F.xxhash64("text") == F.col("_page"), "left")
    return joined.withColumn("text", F.when(F.col("_cuts").isNotNull(), clean).otherwise(text)).select(*docs.columns)
