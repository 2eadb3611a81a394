"""Secret scans with corpus-wide ownership frequency (operator 8).

The base kinds are fixed patterns, matched leftmost and without overlap per kind. The
method adds further candidates: opaque runs of at least 20 characters with a letter and a
digit that touch no base span and look like a credential: they are no UUID and do not read
like a URL path, file path or slug (between ``+ / _ = -`` only words and numbers). The hash
of every candidate's value, base or opaque, is aggregated over the whole corpus by distinct
owners (``source``) and repositories (``source`` and ``lang``). A value that more than
``max_owners`` owners or more than ``max_repositories`` repositories hold, be they of one
owner, is a widely copied example; one that stays with few of both looks live. Live opaque
candidates become spans of kind ``opaque``; base spans stay whatever their frequency, their
class is told in ``n_live`` and ``n_example``. Redaction masks these very spans.

DataFrame functions only. Positions come from the texts between the matches: the matches
of a pattern and the pieces it splits a text into alternate, so a match starts after the
lengths of all pieces and matches before it. The texts are read once and never shuffled;
what moves are candidate hashes (distinct per owner and repository before they are
counted, so a value copied everywhere is no hot group) and spans.

Positions are code points, the end exclusive. Defined results: null text is empty and has
no spans; null owner or repository counts as one unnamed owner; rows with equal
``doc_id`` and text share their spans, others stand alone; an empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkpul.llm.common import materialize, packed

# fixed values: kind, pattern, group that holds the value, least length of that group
KINDS = [
    (
        "assign",
        "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        1,
        6,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    # maximal runs of 24 or more are the matches of [0-9a-f]+ that are long enough
    ("hex", "[0-9a-f]{24,}", 0, 24),
]
OPAQUE = ("opaque", "[A-Za-z0-9+/_=-]{20,}", 0, 20)
NAMES = [k[0] for k in KINDS] + [OPAQUE[0]]
#: what is no credential: a UUID, or a run whose parts are all words or numbers
UUID = "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
SEPARATORS = "[+/_=-]+"
PLAIN_PART = "^([A-Z]?[a-z]+|[A-Z]+|[0-9]{1,12}|[A-Za-z]{1,4}[0-9]{1,4}|[A-Z]?[a-z]{1,10}[0-9]{1,2})?$"
MAX_OWNERS = 2
MAX_REPOSITORIES = 4
MASK = "[SECRET]"


def _matches(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Array of ``struct(start, kind, stop, value)`` of the matches of one pattern."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    zero = F.struct(
        F.lit(0).alias("at"),
        F.array().cast("array<struct<start:int,kind:int,stop:int,value:string>>").alias("out"),
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["hit"])
        span = F.struct(
            start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), x["value"].alias("value")
        )
        return F.struct(
            stop.alias("at"),
            F.when(F.length(x["value"]) >= least, F.concat(acc["out"], F.array(span)))
            .otherwise(acc["out"])
            .alias("out"),
        )

    n = F.size(found)
    triples = F.zip_with(
        F.slice(gaps, F.lit(1), n),
        F.arrays_zip(found.alias("hit"), values.alias("value")),
        lambda g, m: F.struct(g.alias("gap"), m["hit"].alias("hit"), m["value"].alias("value")),
    )
    spans = F.aggregate(triples, zero, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), spans).otherwise(zero["out"])


def _readable(value: Column) -> Column:
    """Whether a run is a UUID or all its parts are words or numbers."""
    return value.rlike(UUID) | F.forall(F.split(value, SEPARATORS), lambda part: part.rlike(PLAIN_PART))


def candidates(docs: DataFrame, owner: str = "source", repository: str = "lang") -> DataFrame:
    """``doc_id, text_hash, owner, repository, base, opaque``: span arrays of every document."""
    text = F.coalesce("text", F.lit(""))
    read = docs.select(
        "doc_id",
        F.xxhash64(text).alias("text_hash"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
        F.concat(*[_matches(text, i, p, g, n) for i, (_, p, g, n) in enumerate(KINDS)]).alias("base"),
        _matches(text, len(KINDS), *OPAQUE[1:]).alias("opaque"),
    )
    clear = F.filter(
        "opaque",
        lambda o: o["value"].rlike("[0-9]")
        & o["value"].rlike("[A-Za-z]")
        & ~_readable(o["value"])
        & ~F.exists("base", lambda b: (b["start"] < o["stop"]) & (o["start"] < b["stop"])),
    )
    return read.withColumn("opaque", clear)


def find_secrets(
    docs: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES
) -> DataFrame:
    """``doc_id, text_hash, spans`` for every document, in the input's number of rows.

    ``spans`` holds ``struct(start, kind, stop, value, owners, repositories, live)`` in order; ``kind``
    counts in ``NAMES``; ``live`` tells owner-specific values.
    """
    read = materialize(candidates(docs), "secret-candidates")
    each = read.select(
        "doc_id", "text_hash", "owner", "repository", F.explode(F.concat("base", "opaque")).alias("s")
    ).withColumn("value_hash", F.xxhash64("s.value"))
    places = each.select("value_hash", "owner", "repository").distinct()
    owners = places.groupBy("value_hash", "owner").agg(F.count("*").alias("n"))
    known = owners.groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    judged = each.join(known, "value_hash").select(
        "doc_id",
        "text_hash",
        F.struct(
            "s.start", "s.kind", "s.stop", "s.value", "owners", "repositories",
            ((F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)).alias("live"),
        ).alias("s"),
    )
    kept = judged.where(f"s.kind < {len(KINDS)} or s.live")
    spans = kept.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("s")).alias("spans"))
    plain = read.select(
        F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"),
        (F.size("base") + F.size("opaque") > 0).alias("some"),
    )
    with_some = plain.where("some").join(
        spans, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left"
    ).select(F.col("id").alias("doc_id"), F.col("hash").alias("text_hash"), "spans")
    without = plain.where("not some").select(
        F.col("id").alias("doc_id"), F.col("hash").alias("text_hash"),
        F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"),
    )
    return with_some.unionByName(without).withColumn("spans", F.coalesce("spans", F.array()))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string")
            ),
        ),
        ",",
    )


def digests(found: DataFrame) -> DataFrame:
    """The contract columns of operator 8 from its spans."""
    def of(test) -> Column:
        return F.size(F.filter("spans", test)).cast("long")

    def is_kind(k: int):
        return lambda s: s["kind"] == k

    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    return found.select(
        "doc_id",
        *[of(is_kind(k)).alias(f"n_{name}") for k, name in enumerate(NAMES[: len(KINDS)])],
        F.sha2(_written(base), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
        of(lambda s: s["live"]).alias("n_live"),
        of(lambda s: ~s["live"]).alias("n_example"),
    )


def redact(
    docs: DataFrame, max_owners: int = MAX_OWNERS, mask: str = MASK, max_repositories: int = MAX_REPOSITORIES
) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mask``; other columns as they are.

    Overlapping spans become one mask. Only documents with spans are joined (and so
    shuffled); all others pass straight through.
    """
    spans = materialize(
        find_secrets(docs, max_owners, max_repositories).where("size(spans) > 0").dropDuplicates(["doc_id", "text_hash"]),
        "secret-spans",
    ).select(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash"), "spans")
    text = F.coalesce("row.text", F.lit(""))
    suspect = F.lit(False)
    for _, pattern, _, _ in [*KINDS, OPAQUE]:
        suspect = suspect | text.rlike(pattern)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substr(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"]).alias("out"),
        )

    masked = F.aggregate("spans", zero, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    own = packed(docs, id=F.col("doc_id"))
    hit = own.where(suspect).join(
        spans, F.col("id").eqNullSafe(F.col("found_id")) & (F.xxhash64(text) == F.col("found_hash")), "left"
    )
    new = F.when(F.col("spans").isNotNull(), masked).otherwise(F.col("row.text"))
    changed = hit.select(F.col("row").withField("text", new).alias("row"))
    return changed.unionByName(own.where(~suspect).select("row")).select("row.*")
