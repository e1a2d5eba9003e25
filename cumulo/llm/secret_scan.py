"""Secret scans with multipart credential linking, in DataFrame functions alone.

Patterns give parts of credentials with their places: secrets and access identifiers that count by
themselves, and weak ones - short or undersized secrets, user names and mail addresses, endpoints -
that count only where complementary parts stand within REACH code points in the same document: an
identifier beside a secret, a weak secret beside an identifier, an endpoint beside both. The interval
join of a document's parts runs over their sorted places and measures from the end of one part to the
start of the next, so that a long part doesn't push its neighbours out.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import checkpointed
from .common import join_hot

#: Code points between parts that belong together.
REACH = 200
#: The base patterns are fixed values; letters of an assignment's name stand in either case.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
USER = r"""(?i:user(?:_?name)?|login|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}|[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"""
ENDPOINT = r"https?://[A-Za-z0-9.-]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
# Repeated groups are bounded: the engine recurses on them, and a long text must not exhaust its stack.
#: Family: its pattern, and the group whose length decides.
FAMILIES = {"assign": (ASSIGN, 2), "access": (ACCESS, 0), "hex": (HEX, 0), "user": (USER, 0), "endpoint": (ENDPOINT, 0)}
#: What every match of a family has in it: texts without it, which a search for fixed strings tells, are not matched.
NEEDS = {"assign": (":", "="), "access": ("AKIA",), "user": (":", "=", "@")}
#: The same of endpoints, beside the slashes: a simple pattern.
DOTTED = r"[0-9]\.[0-9]"
#: Kinds in the order of equal starts; the first three are the base.
KINDS = ("assign", "access", "hex", "short", "digest", "user", "endpoint")
#: Least lengths: of an assigned value, of an access identifier, of a hex run; and of a short value.
VALUE, IDENTIFIER, RUN, SHORT = 8, 16, 32, 4


def _matches(text: Column, family: str) -> Column:
    """Whether the family's pattern matches; the cheaper tests come first."""
    found = text.rlike(FAMILIES[family][0])
    if family == "endpoint":
        return (text.contains("://") | text.rlike(DOTTED)) & found
    needed = [text.contains(part) for part in NEEDS.get(family, ())]
    return functools.reduce(lambda x, y: x | y, needed) & found if needed else found


def _hits(text: Column, family: str) -> Column:
    """For each match in turn: code points between the last match and this one, its length, and that of its group.

    What a text splits into at a pattern and what the pattern matches take turns, so lengths give places.
    """
    pattern, group = FAMILIES[family]
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.char_length)
    inner = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.char_length) if group else sizes
    return F.when(_matches(text, family), F.arrays_zip(F.slice(gaps, 1, F.size(sizes)).alias("gap"), sizes.alias("size"), inner.alias("inner")))


def _kind() -> Column:
    inner, family = F.col("inner"), F.col("family")
    return (
        F.when((family == "assign") & (inner >= VALUE), "assign")
        .when((family == "assign") & (inner >= SHORT), "short")
        .when((family == "access") & (inner >= IDENTIFIER), "access")
        .when((family == "hex") & (inner >= RUN), "hex")
        .when(family == "hex", "digest")
        .when(family.isin("user", "endpoint"), family)
    )


def linked_spans(hit: DataFrame) -> DataFrame:
    """key, spans (the findings in order) and copies (rows of the key) from rows of key, a digest of a text, and its _hits() by family.

    Rows of one key are alike, so that copies of a text are looked at once."""
    alike = hit.groupBy("key").agg(*(F.first(f).alias(f) for f in FAMILIES), F.count(F.lit(1)).alias("copies"))
    families = F.array(*(F.struct(F.lit(f).alias("family"), F.col(f).alias("hits")) for f in FAMILIES))
    rows = alike.select("key", "copies", F.explode(families).alias("_f")).where(F.col("_f.hits").isNotNull())
    rows = rows.select("key", "copies", F.col("_f.family").alias("family"), F.posexplode("_f.hits").alias("at", "_h")).select("key", "copies", "family", "at", "_h.*")

    in_turn = Window.partitionBy("key", "family").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(in_turn)
    parts = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).withColumn("kind", _kind()).where(F.col("kind").isNotNull())

    # Of parts that start before this one the farthest end counts, of those that start after it the first start.
    before = Window.partitionBy("key").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("key").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)

    def beside(*kinds: str) -> Column:
        of_kind = F.col("kind").isin(*kinds)
        ends, starts = F.max(F.when(of_kind, F.col("end"))).over(before), F.min(F.when(of_kind, F.col("start"))).over(after)
        return F.coalesce(ends >= F.col("start") - REACH, F.lit(False)) | F.coalesce(starts <= F.col("end") + REACH, F.lit(False))

    is_secret, is_identifier = beside("assign", "hex", "short", "digest"), beside("access", "user")
    weak = F.when(F.col("kind").isin("short", "digest"), is_identifier).when(F.col("kind") == "user", is_secret).when(F.col("kind") == "endpoint", is_secret & is_identifier)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    told = parts.withColumn("_ok", F.coalesce(weak, F.lit(True))).where("_ok")
    return told.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", order.alias("order"), "end", "kind"))).alias("spans"), F.max("copies").alias("copies"))


def _with_hits(rows: DataFrame) -> DataFrame:
    """rows (text, ...) with each family's _hits() under its name."""
    return rows.withColumns({f: _hits(F.col("text"), f) for f in FAMILIES})


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked, linked for each row of docs.

    spans lists kind:start:end of all findings by start, then kind, in code points, end exclusive;
    linked those of weak parts that complementary ones confirm. Null and empty texts have none. A null
    id stays; repeated rows give repeated rows; columns besides doc_id and text are not read.
    """
    found = _with_hits(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    any_hit = F.coalesce(*(F.col(f"{f}.gap")[0] for f in FAMILIES)).isNotNull()
    found = checkpointed(found.select("doc_id", F.when(any_hit, F.sha2("text", 256)).alias("key"), *FAMILIES))
    hit = found.where(F.col("key").isNotNull())
    told = join_hot(hit.select("doc_id", "key"), checkpointed(linked_spans(hit)), "key", "copies", hit.count(), "left").select("doc_id", "spans")
    kind = told.schema["spans"].dataType

    out = told.unionByName(found.where(F.col("key").isNull()).select("doc_id", F.lit(None).cast(kind).alias("spans")))
    spans = F.coalesce("spans", F.array().cast(kind))
    base, extra = F.filter(spans, lambda s: s["order"] <= 3), F.filter(spans, lambda s: s["order"] > 3)
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    text_of = lambda these: F.array_join(F.transform(these, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(text_of(base), 256).alias("base_sha256"),
        text_of(spans).alias("spans"), F.size(extra).cast("long").alias("n_linked"), text_of(extra).alias("linked"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, findings in the text replaced by [kind].

    Findings that overlap become one, under the first one's kind. n_chars, where docs has it, follows
    a text that changes; all else stays as it is, null texts and columns of any name too. Only rows in
    which a pattern matches are joined with their findings; the others pass by.
    """
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    matches = functools.reduce(lambda x, y: x | y, (_matches(F.col("text"), f) for f in FAMILIES))
    hit = rows.where(matches).withColumn("key", F.sha2("text", 256))
    found = checkpointed(_with_hits(hit.select("key", "text")).drop("text"))
    joined = join_hot(hit, checkpointed(linked_spans(found)), "key", "copies", found.count(), "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def take(done, span):
        piece = F.substring(F.col("text"), (done["at"] + 1).cast("int"), (span["start"] - done["at"]).cast("int"))
        onward = F.struct(span["end"].alias("at"), F.concat(done["out"], piece, F.lit("["), span["kind"], F.lit("]")).alias("out"))
        within = F.struct(F.greatest(done["at"], span["end"]).alias("at"), done["out"].alias("out"))
        return F.when(span["start"] >= done["at"], onward).otherwise(within)

    new = F.aggregate("spans", start, take, lambda done: F.concat(done["out"], F.substring(F.col("text"), (done["at"] + 1).cast("int"), F.char_length("text"))))
    changed = joined.where(F.col("spans").isNotNull()).withColumn("text", new)
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    same = joined.where(F.col("spans").isNull()).select("row").unionByName(rows.where(~matches).select("row"))
    return same.unionByName(changed.select(row.alias("row"))).select("row.*")


def _sql_quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql() -> str:
    """The same rows from the whole `documents` table, in DuckDB's SQL."""
    per_family = " UNION ALL ".join(
        f"""SELECT row_id, '{name}' AS family, unnest(range(len(hits))) AS nth, unnest(list_transform(hits, lambda h: length(h))) AS size,
        unnest(list_transform(inner_hits, lambda h: length(h))) AS inner_size, unnest(list_transform(gaps[1:len(hits)], lambda g: length(g))) AS gap
        FROM (SELECT row_id, regexp_extract_all(text, {_sql_quote(p)}) AS hits, regexp_extract_all(text, {_sql_quote(p)}, {g}) AS inner_hits,
        string_split_regex(text, {_sql_quote(p)}) AS gaps FROM docs WHERE regexp_matches(text, {_sql_quote(p)}))"""
        for name, (p, g) in FAMILIES.items()
    )
    kind = f"""CASE WHEN family = 'assign' AND inner_size >= {VALUE} THEN 'assign' WHEN family = 'assign' AND inner_size >= {SHORT} THEN 'short'
        WHEN family = 'access' AND inner_size >= {IDENTIFIER} THEN 'access' WHEN family = 'hex' AND inner_size >= {RUN} THEN 'hex'
        WHEN family = 'hex' THEN 'digest' WHEN family IN ('user', 'endpoint') THEN family END"""
    beside = lambda *kinds: f"EXISTS (SELECT 1 FROM parts o WHERE o.row_id = p.row_id AND o.kind IN ({', '.join(map(_sql_quote, kinds))}) AND o.start <= p.stop + {REACH} AND o.stop >= p.start - {REACH})"
    order = f"list_position([{', '.join(map(_sql_quote, KINDS))}], kind)"
    span = "kind || ':' || start || ':' || stop"
    joined = lambda only: f"coalesce(string_agg({span}, ',' ORDER BY start, pos) FILTER (WHERE {only}), '')"
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
    found AS ({per_family}),
    placed AS (SELECT row_id, family, inner_size, size, CAST(sum(gap + size) OVER (PARTITION BY row_id, family ORDER BY nth) AS BIGINT) AS stop FROM found),
    parts AS (SELECT row_id, stop - size AS start, stop, {kind} AS kind FROM placed),
    judged AS (SELECT *, {order} AS pos, {beside('assign', 'hex', 'short', 'digest')} AS secret, {beside('access', 'user')} AS identifier FROM parts p WHERE kind IS NOT NULL),
    told AS (SELECT * FROM judged WHERE CASE WHEN kind IN ('short', 'digest') THEN identifier WHEN kind = 'user' THEN secret
        WHEN kind = 'endpoint' THEN secret AND identifier ELSE true END)
    SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
        count(*) FILTER (WHERE kind = 'hex') AS n_hex, sha256({joined('pos <= 3')}) AS base_sha256, {joined('pos IS NOT NULL')} AS spans,
        count(*) FILTER (WHERE pos > 3) AS n_linked, {joined('pos > 3')} AS linked
    FROM docs LEFT JOIN told USING (row_id) GROUP BY row_id, doc_id"""
