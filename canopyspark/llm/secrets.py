"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Every whole text is searched for the patterns of ``BASE`` and, as spans that the method adds, for the
well-known token formats of ``KNOWN``. Positions come from splitting a text at a pattern: the lengths of
the pieces and of the matches between them add up to where each match starts, in code points. What was
found is reduced to a hash, and hashes are counted corpus-wide by distinct repositories and owners.
A hash of ``min_owners`` owners or more is a widely copied example; of the rest, those that look like
placeholders are told from the ones that look live.

A repository is named by its owner and ``repo_col``: ``documents`` has one column of that sort, ``source``, which
stands for the owner; its texts in one language stand for a repository of it. A private key is found whole, and
hashed without its armour and line ends.

Hashes are distinct per owner and repository before they are shuffled by hash, and counts are summed
before the shuffle; what is told of a credential that a large share of all spans has goes to every task
instead of all its spans to one. The documents without any match take no part in the joins. Positions
are added up in blocks, so that a text of very many matches does not copy an array for each.

Edge cases: a null text is empty; null owners and repositories count as one unknown owner and one
unknown repository; repeated rows and null ids keep a row each; an empty table gives an empty table;
other columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyspark.llm.common import cut, join_each, stable

# The patterns, in the order of kinds; the number is the group that holds the secret itself.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: A private key whole: to its footer, or as far as lines of a key go on, with one short line after them.
KEY = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s:,.\\]*(?:-[A-Za-z0-9+/=\s:,.\\]+){0,8}-----END [A-Z ]{0,40}PRIVATE KEY-----"
    r"|(?:(?:(?:\s|\\[nr])+[A-Za-z0-9+/=]{20,}){1,400}(?:[\r\n]+[A-Za-z0-9+/=]{1,19})?)?)"
)
KNOWN = (
    KEY + r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
    r"|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}"
)
#: What does not tell one key from another: line ends, headers and footers.
ARMOUR = r"-----(?:BEGIN|END) [A-Z ]{0,40}PRIVATE KEY-----|\s|\\[nr]"
#: Longer secrets are not judged by the words that chance puts into them.
LONGEST_WORDS = 200
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|change_me|placeholder|your|xxxx|test|fake|redacted|^(.)\1*$"
#: (name, pattern, group of the secret, its least length). Runs of one class that are too short hold no longer one, so their
#: length is in the pattern; what a short assignment covers is passed over, so its length is looked at afterwards.
KINDS = [
    ("assign", ASSIGN, 2, 6),
    ("access", ACCESS, 0, 20),
    ("hex", HEX, 0, 24),
    ("known", KNOWN, 0, 1),
]
#: Matches that are placed in one step, so that arrays grow by blocks.
BLOCK = 256
BASE = [name for name, *_ in KINDS[:3]]
SPAN = "struct<start:int,kind:int,end:int,size:int,hash:string,plain:boolean>"


def quoted(pattern: str) -> str:
    """A raw SQL literal."""
    return "concat(" + ", \"'\", ".join(f"r'{p}'" for p in pattern.split("'")) + ")" if "'" in pattern else f"r'{pattern}'"


def spans_sql(kind: int, text: str) -> str:
    """SQL for the array of a kind's spans in the column ``text``; texts that hold none are only searched once."""
    _, pattern, group, least = KINDS[kind]
    p = quoted(pattern)
    found = f"arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {group}))"
    part, hit, value = "x['0']", "x['1']", "x['2']"
    begin = f"(acc.at + length({part}))"
    told = f"regexp_replace({value}, {quoted(ARMOUR)}, '')" if KINDS[kind][0] == "known" else value
    plain = f"length({value}) <= {LONGEST_WORDS} and {value} rlike {quoted(PLACEHOLDER)}"
    span = f"named_struct('start', {begin}, 'kind', {kind}, 'end', {begin} + length({hit}), 'size', length({value}), 'hash', sha2({told}, 256), 'plain', {plain})"
    none = f"cast(array() as array<{SPAN}>)"

    def placed(start: str, matches: str) -> str:
        return (
            f"aggregate({matches}, named_struct('at', {start}, 'spans', {none}), (acc, x) -> named_struct('at', {begin} + coalesce(length({hit}), 0), "
            f"'spans', case when length({value}) >= {least} then concat(acc.spans, array(cast({span} as {SPAN}))) else acc.spans end))"
        )

    blocks = f"transform(sequence(0, (size(found) - 1) div {BLOCK}), b -> slice(found, b * {BLOCK} + 1, {BLOCK}))"
    # transform over an array of one names a value that is used twice
    add = f"(whole, block) -> transform(array({placed('whole.at', 'block')}), own -> named_struct('at', own.at, 'spans', concat(whole.spans, own.spans)))[0]"
    return (
        f"case when {text} rlike {p} then transform(array({found}), found -> "
        f"aggregate({blocks}, named_struct('at', 0, 'spans', {none}), {add}, whole -> whole.spans))[0] else {none} end"
    )


def with_spans(docs: DataFrame, text: str, out: str = "spans") -> DataFrame:
    """``docs`` with the column ``out``: all spans by start, then kind."""
    kinds = [F.expr(spans_sql(k, text)) for k in range(len(KINDS))]
    return docs.withColumn(out, F.array_sort(F.concat(*kinds)))


def ownership(found: DataFrame, min_owners: int = 3) -> DataFrame:
    """(hash, n_owners, n_repos, shared) from (hash, owner, repo) rows."""
    owned = found.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return owned.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos")).withColumn("shared", F.col("n_owners") >= min_owners)


def judged(docs: DataFrame, id_cols: list[str], owner_col: str, repo_col: str, min_owners: int) -> DataFrame:
    """The spans of ``docs`` (already with spans and row), one row each, with what the corpus says of their hash."""
    rows = docs.where(F.size("spans") > 0).select(*id_cols, F.col(owner_col).alias("owner"), F.col(repo_col).alias("repo"), F.explode("spans").alias("span"))
    rows = cut(rows.select(*id_cols, "owner", "repo", "span", F.col("span.hash").alias("hash")))
    return join_each(rows, ownership(rows, min_owners), ["hash"])


def listed(spans: str, base: bool) -> F.Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*[F.lit(n) for n, *_ in KINDS])
    kept = F.filter(spans, lambda s: s["kind"] < len(BASE)) if base else F.col(spans)
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang", min_owners: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, n_known, base_sha256, spans, and the
    spans by verdict: n_shared (widely copied), n_placeholder and n_live (owner-specific, by their looks), and the largest
    numbers of owners and of repositories that any of its secrets is found at (0 without a secret). The verdict goes by
    owners: a credential in many repositories of one owner is still that owner's. Columns of repositories: ``repo_col``
    within an owner."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), F.monotonically_increasing_id().alias("row"),
    )
    rows = cut(with_spans(rows, "text").drop("text"))
    verdicts = judged(rows, ["row"], "owner", "repo", min_owners).groupBy("row").agg(
        F.count_if("shared").alias("n_shared"),
        F.count_if(~F.col("shared") & F.col("span.plain")).alias("n_placeholder"),
        F.count_if(~F.col("shared") & ~F.col("span.plain")).alias("n_live"),
        F.max("n_owners").alias("most_owners"),
        F.max("n_repos").alias("most_repos"),
    )
    names = ["n_shared", "n_placeholder", "n_live", "most_owners", "most_repos"]
    some = rows.where(F.size("spans") > 0).join(verdicts, "row").select("doc_id", "spans", *names)
    none = rows.where(F.size("spans") == 0).select("doc_id", "spans", *[F.lit(0).cast("long").alias(n) for n in names])
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return some.unionByName(none).select(
        "doc_id", *[number(k).alias(f"n_{name}") for k, (name, *_) in enumerate(KINDS)],
        F.sha2(listed("spans", True).cast("binary"), 256).alias("base_sha256"), listed("spans", False).alias("spans"), *names,
    )


def redact(docs: DataFrame, text_col: str = "text", owner_col: str = "source", repo_col: str = "lang", min_owners: int = 3, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret that is not a widely copied example replaced by ``mark``; same columns, same rows.

    Of an assignment only the value goes, a private key goes whole. Overlapping spans become one mark.
    """
    columns = docs.columns
    row = "row number of a document"
    number = stable(docs).withColumn(row, F.monotonically_increasing_id())
    rows = number.select(
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        F.col(f"`{owner_col}`").cast("string").alias("owner"), F.col(f"`{repo_col}`").cast("string").alias("repo"), F.col(row),
    )
    rows = cut(with_spans(rows, "text").drop("text").where(F.size("spans") > 0))
    secret = judged(rows, [row], "owner", "repo", min_owners).where(~F.col("shared"))
    gone = secret.groupBy(row).agg(F.array_sort(F.collect_set(F.struct((F.col("span.end") - F.col("span.size")).alias("start"), F.col("span.end").alias("end")))).alias("secrets of a document"))
    text, gaps = F.col(f"`{text_col}`"), F.col("secrets of a document")
    piece = lambda acc, x: F.when(
        x["start"] >= acc["at"], F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], text.substr(acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark)).alias("out"))
    ).otherwise(F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out")))
    cleaned = F.aggregate(gaps, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), piece, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    told = number.join(gone, row, "left")
    return told.select(*[(F.when(gaps.isNull(), text).otherwise(cleaned) if c == text_col else F.col(f"`{c}`")).alias(c) for c in columns])


# DuckDB's side: the patterns written out once more, in the base form, and least lengths of group and match
DUCK = [
    (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    (r"AKIA[A-Z0-9]+", 0, 20),
    (r"[0-9a-f]+", 0, 24),
    (
        r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s:,.\\]*(?:-[A-Za-z0-9+/=\s:,.\\]+){0,8}-----END [A-Z ]{0,40}PRIVATE KEY-----|(?:(?:(?:\s|\\[nr])+[A-Za-z0-9+/=]{20,})+(?:[\r\n]+[A-Za-z0-9+/=]{1,19})?)?)"
        r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}",
        0,
        1,
    ),
]


def duck_spans(kind: int) -> str:
    pattern, group, least = DUCK[kind]
    p = "'" + pattern.replace("'", "''") + "'"
    told = "regexp_replace(value, '-----(?:BEGIN|END) [A-Z ]{0,40}PRIVATE KEY-----|\\s|\\\\[nr]', '', 'g')" if kind == 3 else "value"
    return f"""
    select row, start, {kind} as kind, start + length(hit) as stop, value, {told} as told from (
      select row, hit, value, sum(length(part)) over w + sum(coalesce(before, 0)) over w as start from (
        select row, part, hit, value, lag(length(hit)) over (partition by row order by i) as before, i from (
          select row, unnest(string_split_regex(text, {p})) as part, unnest(regexp_extract_all(text, {p}, 0)) as hit,
            unnest(regexp_extract_all(text, {p}, {group})) as value, generate_subscripts(string_split_regex(text, {p}), 1) as i
          from rows_of where regexp_matches(text, {p})))
      window w as (partition by row order by i rows unbounded preceding))
    where length(value) >= {least}"""


ORACLE_SQL = f"""
with rows_of as (select row_number() over () as row, doc_id, coalesce(text, '') as text, coalesce(source, chr(0)) as owner, coalesce(lang, chr(0)) as repo from documents),
found as ({" union all ".join(duck_spans(k) for k in range(4))}),
judged as (
  select f.*, sha256(told) as hash, d.owner, d.repo, length(value) <= 200 and (
    regexp_matches(value, '(?i)example|sample|dummy|changeme|change_me|placeholder|your|xxxx|test|fake|redacted') or length(replace(value, value[1], '')) = 0) as plain
  from found f join rows_of d using (row)),
owned as (select hash, count(distinct owner) as n_owners, count(distinct owner || chr(1) || repo) as n_repos from judged group by hash),
told as (
  select row, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex, count(*) filter (kind = 3) as n_known,
    string_agg(['assign', 'access', 'hex', 'known'][kind + 1] || ':' || start::bigint || ':' || stop::bigint, ',' order by start, kind) filter (kind < 3) as base,
    string_agg(['assign', 'access', 'hex', 'known'][kind + 1] || ':' || start::bigint || ':' || stop::bigint, ',' order by start, kind) as spans,
    count(*) filter (n_owners >= 3) as n_shared, count(*) filter (n_owners < 3 and plain) as n_placeholder, count(*) filter (n_owners < 3 and not plain) as n_live,
    max(n_owners) as most_owners, max(n_repos) as most_repos
  from judged join owned using (hash) group by row)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, coalesce(n_known, 0) as n_known,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
  coalesce(n_shared, 0) as n_shared, coalesce(n_placeholder, 0) as n_placeholder, coalesce(n_live, 0) as n_live,
  coalesce(most_owners, 0) as most_owners, coalesce(most_repos, 0) as most_repos
from rows_of d left join told using (row)
"""
