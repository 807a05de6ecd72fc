"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Base rules find three kinds of span per text, leftmost and non-overlapping per
kind (as a regular-expression scan from the left finds them), and drop matches
that fail their length:

- ``assign``: a key word, ``:`` or ``=``, and a value whose group 2 has 8 or more
  characters;
- ``access``: ``AKIA`` and upper-case letters or digits, 16 or more characters;
- ``hex``: a run of lower-case hexadecimal digits, 32 or more characters.

For ``access`` and ``hex`` the length test is part of the pattern: a run the
plain pattern would match and drop cannot hide a longer match inside it, so
both scans give the same spans. ``assign`` is scanned with the plain pattern and
filtered afterwards, as a dropped match still hides what overlaps it.

Positions come from splitting the text by the same pattern: the pieces between
matches and the matches alternate, so a match starts after all earlier pieces
and matches. Those prefix sums are a running window sum over one row per
match, partitioned by the row, so a text with many matches costs n log n, not n².

The method adds spans of kind ``owned``. Candidates are runs of 20 or more
characters of ``[A-Za-z0-9+/_=-]`` that look generated (a digit, a letter and
at least ``LIVE_DISTINCT`` distinct characters) and overlap no base span.
Every candidate string is hashed, and the corpus counts the distinct
repositories (``source``) and owners (``source`` up to its first ``/``) it
occurs under: first distinct (hash, owner) pairs, then a count by hash, so a
string copied into a third of the corpus is folded where it lies before any
shuffle. A string found under ``COPIED_OWNERS`` or more owners, or
``COPIED_REPOS`` or more repositories, is a widely copied example and is
counted in ``n_copied``; the others are owner-specific, live-looking
credentials and become ``owned`` spans. Base spans always stay.

Odd rows: a null text scans as empty (no spans; ``base_sha256`` is the digest of
the empty string). A null source belongs to the owner and repository ``""``.
Null or repeated ``doc_id`` values keep one output row per input row; equal
rows give equal results. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querent.session import stored

# The base rules as the contract states them.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
BASE_KINDS = ("assign", "access", "hex")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
LIVE_DISTINCT = 12
COPIED_OWNERS = 3
COPIED_REPOS = 5
#: Order of kinds at equal starts: as listed, the method's kind last.
KINDS = (*BASE_KINDS, "owned")


def _matches(text: Column, pattern: str, kind: str) -> Column:
    """One struct per match: the piece before it, its length, and whether it counts."""
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    order = KINDS.index(kind)

    def one(match: Column, i: Column) -> Column:
        if kind == "assign":
            valid = F.length(F.regexp_extract(match, pattern, 2)) >= 8
        else:
            valid = F.lit(True)
        if kind == "owned":
            chars = F.size(F.array_distinct(F.split(match, "")))
            live = match.rlike("[0-9]") & match.rlike("[A-Za-z]") & (chars >= LIVE_DISTINCT)
            h1, h2 = F.xxhash64(match), F.crc32(match.cast("binary"))
        else:
            live, h1, h2 = F.lit(None).cast("boolean"), F.lit(None).cast("long"), F.lit(None).cast("long")
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(order).alias("order"), i.alias("idx"),
            F.length(pieces[i]).alias("piece"), F.length(match).alias("length"), valid.alias("valid"),
            live.alias("live"), h1.alias("h1"), h2.alias("h2"),
        )

    return F.transform(found, one)


def _spans(rows: DataFrame) -> DataFrame:
    """``(row, kind, order, start, end, valid, live, h1, h2)``, one row per match; no match: kind null."""
    text = F.coalesce(F.col("text"), F.lit(""))
    all_matches = F.concat(
        _matches(text, ASSIGN, "assign"), _matches(text, ACCESS, "access"),
        _matches(text, HEX, "hex"), _matches(text, CANDIDATE, "owned"),
    )
    exploded = rows.select("row", "doc_id", "owner", "repo", F.explode_outer(all_matches).alias("m")).select(
        "row", "doc_id", "owner", "repo", "m.*"
    )
    # one shuffle by row serves both windows
    exploded = exploded.repartition("row")
    upto = Window.partitionBy("row", "kind").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.col("piece") + F.col("length")).over(upto) - F.col("length")
    placed = exploded.withColumn("start", start.cast("long")).withColumn("end", F.col("start") + F.col("length"))
    base = F.col("valid") & (F.col("order") < len(BASE_KINDS))
    by_start = Window.partitionBy("row").orderBy("start", "order", "idx")
    before = by_start.rowsBetween(Window.unboundedPreceding, -1)
    after = by_start.rowsBetween(1, Window.unboundedFollowing)
    overlaps = (F.max(F.when(base, F.col("end"))).over(before) > F.col("start")) | (
        F.min(F.when(base, F.col("start"))).over(after) < F.col("end")
    )
    return placed.withColumn("overlaps", F.coalesce(overlaps, F.lit(False)))


def _joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    ordered = F.array_sort(spans)
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def scan_secrets(docs: DataFrame, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per input row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_copied``.

    ``spans`` joins base and ``owned`` spans like ``base_sha256``'s input; start
    and end count code points, end exclusive.
    """
    source = F.col(source_col)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id"),
        F.col(text_col).alias("text"),
        F.coalesce(F.substring_index(source, "/", 1), F.lit("")).alias("owner"),
        F.coalesce(source, F.lit("")).alias("repo"),
    )
    # matched once; the ownership counts and the rows read the stored spans
    spans = stored(_spans(rows), "secret-spans")
    candidate = (F.col("kind") == "owned") & F.col("live") & ~F.col("overlaps")
    candidates = spans.filter(candidate)
    # distinct pairs first: a hot string is folded where it lies
    owners = candidates.select("h1", "h2", "owner").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_owners"))
    repos = candidates.select("h1", "h2", "repo").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_repos"))
    stats = owners.join(repos, ["h1", "h2"])
    copied = (F.col("n_owners") >= COPIED_OWNERS) | (F.col("n_repos") >= COPIED_REPOS)
    judged = candidates.join(stats, ["h1", "h2"]).withColumn("copied", copied)
    others = spans.filter(~F.coalesce(candidate, F.lit(False))).withColumn("copied", F.lit(None).cast("boolean"))
    every = judged.select(others.columns).unionByName(others)
    span = F.struct(F.col("start"), F.col("order"), F.col("kind"), F.col("end"))
    is_base = F.col("valid") & (F.col("order") < len(BASE_KINDS))
    added = F.col("copied") == F.lit(False)
    out = every.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        *[F.count_if(is_base & (F.col("kind") == k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.collect_list(F.when(is_base, span)).alias("base"),
        F.collect_list(F.when(is_base | added, span)).alias("all"),
        F.count_if(added).cast("long").alias("n_owned"),
        F.count_if(F.col("copied")).cast("long").alias("n_copied"),
    )
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("all")).alias("spans"), "n_owned", "n_copied",
    )
