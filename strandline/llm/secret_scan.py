"""Secret scans by corpus-wide ownership frequency (operator 8, DataFrame functions only).

Candidates are found by patterns in whole texts.  The hash of each candidate's
value is then counted over distinct repositories and owners: a value that many
owners have is a copied example, one that stays with few is a live-looking
credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved

#: kind, pattern (Java syntax), group that is the value, least characters of the value.
#: A run of at least n characters of a class is the whole run, if that is as long, so access and hex have their length in the pattern.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
FURTHER = (
    ("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]{40,}-----END [A-Z ]{0,30}PRIVATE KEY-----", 0, 60),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("vendor", r"\b(?:gh[opsu]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{16,})", 0, 20),
)
#: Distinct owners from which a value counts as a copied example.
EXAMPLE_OWNERS = 3
#: Or distinct repositories, under two owners at least.
EXAMPLE_REPOSITORIES = 10
#: Parts that the rows of one value are split into where they meet its counts.
SALTS = 8
#: Matches whose spans are appended one by one; longer lists are put together from such runs.
RUN = 256


def _spans(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches of one kind as structs; a match starts after the pieces between the matches and the matches before it."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(hits)).alias("piece"), hits.alias("hit"))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(hits) / RUN).cast("int") - 1, F.lit(0))), lambda i: F.slice(pairs, i * RUN + 1, F.lit(RUN)))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["piece"])
        end = start + F.length(x["hit"])
        value = F.regexp_extract(x["hit"], pattern, group) if group else x["hit"]
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), value.alias("value")))
        return F.struct(end.alias("at"), F.when(F.length(value) >= least, F.concat(state["found"], one)).otherwise(state["found"]).alias("found"))

    def run(state: Column, some: Column) -> Column:
        own = F.aggregate(some, F.struct(state["at"].alias("at"), empty.alias("found")), step)
        both = F.transform(F.array(own), lambda x: F.struct(x["at"].alias("at"), F.concat(state["found"], F.array(x["found"])).alias("found")))  # own is evaluated once
        return F.get(both, F.lit(0))

    none = F.array().cast("array<array<struct<start:int,rank:int,end:int,kind:string,value:string>>>")
    found = F.aggregate(runs, F.struct(F.lit(0).alias("at"), none.alias("found")), run, lambda s: F.flatten(s["found"]))
    return F.when(text.rlike(pattern), found).otherwise(empty)


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = None) -> DataFrame:
    """doc_id, owner, repository (by default the document) and spans by start, then kind; one scan, no shuffle."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = [_spans(F.col("text"), i, *kind) for i, kind in enumerate(BASE + FURTHER)]
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository or doc_id).cast("string").alias("repository"), body.alias("text"))
    return own.select("doc_id", "owner", "repository", F.sort_array(F.concat(*found)).alias("spans"))


def ownership(found: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """hash, owners, repositories, example for each candidate value of candidates().

    Counted in steps of partial sums, so a value in a third of all documents costs a row an owner and task.
    Nulls count as one owner, or repository.
    """
    each = found.select("owner", "repository", F.explode("spans.value").alias("value")).select(F.sha2("value", 256).alias("hash"), "owner", "repository")
    by_owner = each.distinct().groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    counts = by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))
    return counts.withColumn("example", F.expr(f"owners >= {example_owners} or (owners > 1 and repositories >= {example_repositories})"))


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def judge(found: DataFrame, **limits: int) -> DataFrame:
    """row, judged for rows (row, owner, repository, spans): each span with its value's counts, by start, then kind.

    The rows of one value are split over SALTS tasks, each with a copy of its counts.
    """
    each = found.where(F.size("spans") > 0).select("row", F.explode("spans").alias("s"))
    each = each.withColumn("hash", F.sha2("s.value", 256)).withColumn("salt", F.expr(f"pmod(xxhash64(row), {SALTS})"))
    counts = ownership(found, **limits).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    one = F.struct("s.start", "s.rank", "s.end", "s.kind", "hash", "owners", "repositories", "example")
    return each.join(counts, ["hash", "salt"]).groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("judged"))


def secret_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = None, **limits: int) -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, judged.

    spans: kind:start:end of all candidates, by start, then kind, in code points;
    base_sha256 hashes those of the three base kinds.  judged has each span with
    its value's counts, and whether it is an example.  A null text is empty; ids
    may repeat or be null; other columns are ignored; an empty table gives no rows.
    """
    found = saved(candidates(docs, doc_id, text, owner, repository).withColumn("row", F.monotonically_increasing_id()), "candidates")
    base = F.filter("spans", lambda x: x["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    own = lambda flag: F.when(F.col("judged").isNull(), 0).otherwise(F.size(F.filter("judged", lambda x: x["example"] == F.lit(flag)))).cast("long")
    out = found.join(judge(found, **limits), "row", "left")
    return out.select("doc_id", *(count(k[0]) for k in BASE), F.sha2(_text_of(base), 256).alias("base_sha256"), _text_of(F.col("spans")).alias("spans"), own(False).alias("n_live"), own(True).alias("n_example"), "judged")


def redact_live(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = None, mark: str = "[SECRET]", **limits: int) -> DataFrame:
    """docs with every live-looking credential replaced by mark; all columns and rows stay.

    Overlapping spans are replaced as one.  Rows with a null text or without live
    spans stay as they are.  Texts are scanned once, and only those with
    candidates are shuffled.
    """
    spans = F.sort_array(F.concat(*(_spans(F.coalesce(F.col(text).cast("string"), F.lit("")), i, *kind) for i, kind in enumerate(BASE + FURTHER))))
    scanned = saved(docs.withColumn("__spans", spans).withColumn("__row", F.monotonically_increasing_id()), "scanned")
    held = scanned.where(F.size("__spans") > 0)
    found = held.select(F.col("__row").alias("row"), F.col(owner).cast("string").alias("owner"), F.col(repository or doc_id).cast("string").alias("repository"), F.col("__spans").alias("spans"))
    live = judge(found, **limits).select(F.col("row").alias("__of"), F.filter("judged", lambda x: ~x["example"]).alias("__cut"))
    body = F.col(text)

    def step(state: Column, x: Column) -> Column:
        gap = F.substring(body, state["at"] + 1, F.greatest(x["start"] - state["at"], F.lit(0)))
        fresh = x["start"] >= state["at"]
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.when(fresh, F.concat(state["out"], F.array(gap, F.lit(mark)))).otherwise(state["out"]).alias("out"))

    tail = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate("__cut", tail, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(body, s["at"] + 1, F.length(body))))
    joined = held.join(live, F.col("__row") == F.col("__of"), "left")
    changed = joined.select(*(F.when(F.size("__cut") > 0, clean).otherwise(body).alias(text) if c == text else F.col(c) for c in docs.columns))
    return changed.union(scanned.where(F.size("__spans") == 0).select(*docs.columns))
