"""DuckDB SQL with the same result as each registered query.

Written from the definition of each operator and not from its Spark form:
windows over whole strata, lists, and one CTE pair per quota pass.
"""

from __future__ import annotations

import math

from corpusloom.registry.derived import (
    CANDIDATES_SQL, CASES_SQL, CATALOG_SQL, COLUMN_CANDIDATES_SQL, COLUMN_RESULTS_SQL, CORPUS_SQL,
    EVIDENCE_SQL, PRED_SQL, RESULTS_SQL,
)
from corpusloom.registry.queries import (
    BINDING_CAP, CAP, LARGE_CAP, REPLICATES, SAMPLE, SEED, TAKE, TEMPLATE, TOKEN_CAP, TOP_K, TRUNCATED,
)

# Fixed values, stated here again so that a wrong constant of an operator shows.
QUOTAS = {
    "set_op": 50,
    "nested": 90,
    "having": 70,
    "multi_join": 100,
    "group_by": 80,
    "single_join": 60,
    "single_table_analytic": 50,
    "simple": 0,
}
HALF_QUOTAS = {name: quota // 2 for name, quota in QUOTAS.items()}
BUCKETS = (*QUOTAS,)
FEATURES = ("join", "group_by", "having", "order_by", "agg", "nested", "set_op", "window")
SYSTEM_PROMPT = "You are an expert SQL generator. Return only executable SQL with no explanation."
# Text before a role, between role and content, after the content.
TEMPLATES = {
    "im_start": ("<|im_start|>", "\n", "<|im_end|>\n"),
    "header_id": ("<|start_header_id|>", "<|end_header_id|>\n\n", "<|eot_id|>"),
    "im_sep": ("<|im_start|>", "<|im_sep|>", "<|im_end|>"),
}

# ASCII white space is enough for the derived corpus; documents need all of it.
BLANKS = "chr(9) || chr(10) || chr(13) || ' '"
ANY_SPACE = (
    r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


# ---- scalar fragments ---------------------------------------------------------

def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def no_semicolons(x: str) -> str:
    return f"rtrim({x}, ';')"


def clean(x: str) -> str:
    return f"rtrim({no_semicolons(strip(x))}, {BLANKS})"


def collapse(x: str) -> str:
    parts = (
        f"list_transform(string_split({x}, ''''), lambda p, i: CASE WHEN i % 2 = 1 "
        r"THEN regexp_replace(p, '\s+', ' ', 'g') ELSE p END)"
    )
    return strip(no_semicolons(strip(f"array_to_string({parts}, '''')")))


def norm(x: str) -> str:
    spaced = strip(rf"regexp_replace({no_semicolons(strip(x))}, '\s+', ' ', 'g')")
    return rf"upper(regexp_replace({spaced}, '\s*([(),=<>])\s*', '\1', 'g'))"


def unfenced(x: str) -> str:
    parts = f"string_split({strip(x)}, '```')"
    inner = f"regexp_replace({parts}[-2], 'sql', '')"
    return f"CASE WHEN contains({x}, '```') THEN {strip(inner)} ELSE {strip(x)} END"


def times(s: str, token: str) -> str:
    return f"((length({s}) - length(replace({s}, '{token}', ''))) // {len(token)})"


def tests(x: str) -> dict[str, str]:
    s = f"(' ' || upper({x}) || ' ')"

    def has(pattern: str) -> str:
        return f"regexp_matches({s}, '{pattern}')"

    return {
        "join": f"contains({s}, ' JOIN ')",
        "group_by": has(r"\bGROUP BY\b"),
        "having": has(r"\bHAVING\b"),
        "order_by": has(r"\bORDER BY\b"),
        "agg": has(r"\b(COUNT|SUM|AVG|MIN|MAX)\s*\("),
        "nested": f"{times(s, 'SELECT')} >= 2",
        "set_op": has(r"\b(UNION|INTERSECT|EXCEPT)\b"),
        "window": has(r"\bOVER\s*\("),
        "joins": times(s, " JOIN "),
    }


def bucket(x: str) -> str:
    t = tests(x)
    when = {
        "set_op": t["set_op"],
        "nested": t["nested"],
        "having": t["having"],
        "multi_join": f"{t['joins']} >= 2",
        "group_by": t["group_by"],
        "single_join": f"{t['joins']} = 1",
        "single_table_analytic": f"{t['agg']} OR {t['order_by']}",
    }
    arms = " ".join(f"WHEN {when[b]} THEN '{b}'" for b in BUCKETS[:-1])
    return f"CASE {arms} ELSE '{BUCKETS[-1]}' END"


def key(seed: int, row_id: str) -> str:
    return f"md5('{seed}|' || {row_id}::VARCHAR)"


def share(n: str, fraction: float) -> str:
    return (
        f"CASE WHEN {n} >= 3 THEN greatest(1, round_even({n} * {fraction}::DOUBLE, 0)::BIGINT) "
        "ELSE 0 END"
    )


def rendered(name: str, target: str = "target") -> str:
    before, after, end = TEMPLATES[name]

    def quoted(s: str) -> str:
        return " || chr(10) || ".join(f"'{part}'" for part in s.split("\n"))

    turns = [("system", "sys"), ("user", "usr"), ("assistant", target)]
    return " || ".join(
        f"{quoted(before + role + after)} || {column} || {quoted(end)}"
        for role, column in turns
    )


def breaks(x: str) -> str:
    """A corpus target that is no SQL, known from how it is built."""
    return f"({x} LIKE 'SELECT (a%' OR {x} LIKE 'select (a%' OR {x} = 'SELECT FROM WHERE')"


# ---- table fragments ----------------------------------------------------------

CORPUS = f"corpus AS ({CORPUS_SQL.format(orders='orders')})"
PRED = f"pred AS ({PRED_SQL.format(corpus='corpus')})"
CATALOG = "catalog AS (" + CATALOG_SQL.format(customer="customer").replace("<<", "[").replace(
    ">>", "]") + ")"
CASES = "cases AS (" + CASES_SQL.format(corpus="corpus").replace("<<", "[").replace(">>", "]") + ")"
SCHEMAS = r"""
schemas AS (
  SELECT db_id,
    'Tables' || chr(10) || chr(10) || array_to_string(list_transform(table_names_original,
      lambda t, i: t || '(' || chr(10) || '    ' || array_to_string(list_transform(
        list_filter(column_names_original, lambda c: c[1]::INT = i - 1), lambda c: c[2]),
        ',' || chr(10) || '    ') || chr(10) || ')'), chr(10) || chr(10))
    || CASE WHEN len(foreign_keys) = 0 THEN '' ELSE
      chr(10) || chr(10) || 'Foreign Keys' || chr(10) || chr(10) || array_to_string(
        list_transform(foreign_keys, lambda f:
          table_names_original[column_names_original[f[1] + 1][1]::INT + 1] || '.'
          || column_names_original[f[1] + 1][2] || ' -> '
          || table_names_original[column_names_original[f[2] + 1][1]::INT + 1] || '.'
          || column_names_original[f[2] + 1][2]), chr(10)) END AS schema_text
  FROM catalog)"""


def user_prompt(evidence: str = "''") -> str:
    nl = "chr(10) || chr(10)"
    return (
        f"'Database: ' || db_id || {nl} || 'Schema:' || {nl} || schema_text || {evidence} || {nl} "
        f"|| 'Question:' || chr(10) || question || {nl} || 'Return only SQL.'"
    )


RECORDS = f"""
records AS (
  SELECT rec_id, source, db_id, '{SYSTEM_PROMPT}' AS sys, {user_prompt()} AS usr,
         {clean('sql_raw')} AS target, sql_raw
  FROM corpus JOIN schemas USING (db_id))"""
CLASSIFIED = f"""
collapsed AS (SELECT rec_id, source, db_id, question, {collapse('sql_raw')} AS sql FROM corpus),
classified AS (SELECT *, {bucket('sql')} AS bucket FROM collapsed)"""
POOL = f"""
pool AS MATERIALIZED (
  SELECT rec_id, source, db_id, question, sql, bucket, {key(SEED, 'rec_id')} AS u FROM classified
  QUALIFY row_number() OVER (PARTITION BY db_id, upper(sql) ORDER BY rec_id) = 1)"""


def split_cte(
    table: str, strata: str, row_id: str, seed: int = SEED, val: float = 0.1, test: float = 0.1
) -> str:
    return f"""
ranked AS (SELECT *, count(*) OVER (PARTITION BY {strata}) AS n,
    row_number() OVER (PARTITION BY {strata} ORDER BY {key(seed, row_id)}, {row_id}) AS r
  FROM {table}),
labelled AS (SELECT * EXCLUDE (n, r),
    CASE WHEN r <= {share('n', test)} THEN 'test'
         WHEN r <= {share('n', test)} + {share('n', val)} THEN 'validation'
         ELSE 'train' END AS split
  FROM ranked)"""


SPLIT = split_cte("pool", "source, bucket", "rec_id")


def quota_ctes(quotas: dict[str, int], cap: int, size: int | None = None) -> str:
    """CTE chain of the greedy fill; the last CTE, ``picks``, has all picks."""
    parts, done, pass_no = [], None, 0
    columns = "rec_id, db_id, bucket, u"

    def step(source: str, limit: str) -> None:
        nonlocal done, pass_no
        if done is None:
            left = f"(SELECT *, {cap} AS room FROM ({source}))"
        else:
            left = (
                f"(SELECT s.*, {cap} - coalesce(g.used, 0) AS room FROM ({source}) s LEFT JOIN "
                f"(SELECT db_id, count(*) AS used FROM {done} GROUP BY db_id) g USING (db_id))"
            )
        parts.append(
            f"s{pass_no} AS MATERIALIZED (SELECT {columns}, {pass_no} AS pick_pass FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY u, rec_id) AS r "
            f"FROM {left}) WHERE r <= room ORDER BY u, rec_id LIMIT {limit})"
        )
        before = f"SELECT * FROM {done} UNION ALL " if done else ""
        parts.append(f"a{pass_no} AS MATERIALIZED ({before}SELECT * FROM s{pass_no})")
        done = f"a{pass_no}"
        pass_no += 1

    for name, quota in quotas.items():
        if quota > 0:
            step(f"SELECT {columns} FROM pool WHERE bucket = '{name}'", str(quota))
    if size is not None:
        step(
            f"SELECT {columns} FROM pool WHERE rec_id NOT IN (SELECT rec_id FROM {done})",
            f"(SELECT greatest(0, {size} - count(*)) FROM {done})",
        )
    parts.append(f"picks AS (SELECT * FROM {done})")
    return ", ".join(parts)


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(c.strip() for c in ctes) + "\n"


ON_POOL = (CORPUS, CLASSIFIED, POOL)
ON_RECORDS = (CORPUS, CATALOG, SCHEMAS, RECORDS)
MEASURES = """count(*) AS n, count(*) FILTER (WHERE parse_ok) AS parse_ok,
        count(*) FILTER (WHERE em) AS em,
        count(*) FILTER (WHERE parse_ok)::DOUBLE / count(*) AS parse_rate,
        count(*) FILTER (WHERE em)::DOUBLE / count(*) AS normalized_em"""
PICKS = "SELECT rec_id, db_id, bucket, pick_pass FROM picks"

# Cumulative probabilities of a Poisson count of mean one, of 2 ** 32.
POISSON = [int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2**32) for k in range(13)]

ORACLES: dict[str, str] = {}


def _text() -> None:
    ORACLES["collapse_sql"] = with_(CORPUS) + f"SELECT rec_id, {collapse('sql_raw')} AS sql FROM corpus"
    ORACLES["clean_target"] = with_(CORPUS) + f"""
        SELECT rec_id, {clean('sql_raw')} AS sql,
               ends_with({strip('sql_raw')}, ';') AS fixed FROM corpus"""
    ORACLES["norm_sql"] = with_(CORPUS) + f"SELECT rec_id, {norm('sql_raw')} AS sql FROM corpus"
    ORACLES["mask_backticks"] = with_(CORPUS) + """
        SELECT rec_id, regexp_replace(sql_raw, '`[^`]*`', 'x', 'g') AS sql FROM corpus"""
    ORACLES["unfence"] = with_(CORPUS, PRED) + f"""
        SELECT rec_id, {unfenced('pred_raw')} AS sql FROM pred"""
    ORACLES["db_of"] = with_(*ON_RECORDS) + "SELECT rec_id, db_id AS db FROM records"
    ORACLES["question_tail"] = with_(*ON_RECORDS) + f"""
        SELECT rec_id, {strip("substr(string_split(usr, 'Question:')[-1], 1, 120)")} AS question
        FROM records"""
    ORACLES["est_tokens"] = """
        SELECT doc_id, floor(length(text) / 3.5::DOUBLE)::BIGINT AS tokens FROM documents"""


def _structure() -> None:
    flags = tests("sql_raw")
    sums = ", ".join(
        f"count(*) FILTER (WHERE {flags[name]}) AS \"{name}\"" for name in FEATURES
    )
    ORACLES["bucket_counts"] = with_(CORPUS, CLASSIFIED) + """
        SELECT source, bucket, count(*) AS n FROM classified GROUP BY source, bucket"""
    ORACLES["bucket_raw"] = with_(CORPUS) + f"SELECT rec_id, {bucket('sql_raw')} AS bucket FROM corpus"
    ORACLES["feature_flags"] = with_(CORPUS) + "SELECT rec_id, " + ", ".join(
        f"{flags[name]} AS has_{name}" for name in FEATURES) + " FROM corpus"
    ORACLES["feature_totals"] = with_(CORPUS) + f"SELECT count(*) AS n, {sums} FROM corpus"
    ORACLES["feature_rollup"] = with_(CORPUS) + f"""
        SELECT coalesce(source, 'merged') AS source, count(*) AS n, {sums}
        FROM corpus GROUP BY ROLLUP (source)"""


def _prompts() -> None:
    hint = f"""CASE WHEN ({EVIDENCE_SQL}) IS NULL OR ({EVIDENCE_SQL}) = '' THEN ''
        ELSE chr(10) || chr(10) || 'Evidence:' || chr(10) || ({EVIDENCE_SQL}) END"""
    ORACLES["render_schema"] = with_(CATALOG, SCHEMAS) + "SELECT db_id, schema_text FROM schemas"
    ORACLES["build_records"] = with_(*ON_RECORDS) + "SELECT rec_id, sys, usr, target FROM records"
    ORACLES["prompt_evidence"] = with_(CORPUS, CATALOG, SCHEMAS) + f"""
        SELECT rec_id, {user_prompt(hint)} AS prompt FROM corpus JOIN schemas USING (db_id)"""
    ORACLES["render_chat"] = with_(*ON_RECORDS) + "SELECT rec_id, " + ", ".join(
        f"{rendered(name)} AS {name}" for name in TEMPLATES) + " FROM records"
    end = TEMPLATES[TEMPLATE][2]
    ORACLES["completion_span"] = with_(*ON_RECORDS) + f"""
        SELECT rec_id, true AS found,
               left(text, length(text) - length(target) - {len(end)}) AS prompt,
               target || '{end}' AS completion,
               false AS other_found, NULL::VARCHAR AS other_completion
        FROM (SELECT rec_id, target, {rendered(TEMPLATE)} AS text FROM records)"""


def _gates() -> None:
    ORACLES["role_check"] = """
        SELECT conv_id, count(*) AS n_turns,
               list(role ORDER BY turn) = ['system', 'user', 'assistant'] AS ok
        FROM conversations GROUP BY conv_id"""
    fixed = f"ends_with({strip('sql_raw')}, ';')"
    ORACLES["clean_records"] = with_(CORPUS) + f"""
        SELECT rec_id, {clean('sql_raw')} AS sql, {fixed} AS fixed,
               NOT {breaks('sql_raw')} AS parses FROM corpus"""
    ORACLES["parse_gate"] = with_(CORPUS) + f"""
        SELECT rec_id FROM corpus WHERE {breaks('sql_raw')}"""
    ORACLES["cleaning_report"] = with_(CORPUS) + f"""
        SELECT count(*) AS records, count(*) FILTER (WHERE {fixed}) AS fixed_semicolons,
               count(*) FILTER (WHERE {breaks('sql_raw')}) AS unparseable FROM corpus"""
    ORACLES["window_function_audit"] = with_(CORPUS) + f"""
        SELECT count(*) AS n, count(*) FILTER (WHERE {tests('sql_raw')['window']}) AS n_window
        FROM corpus"""
    ORACLES["alignment_check"] = """
        SELECT (SELECT count(*) FROM documents) AS n_gold, (SELECT count(*) FROM labels) AS n_pred,
               count(*) AS n_pairs,
               (SELECT count(*) FROM documents) + (SELECT count(*) FROM labels) - 2 * count(*)
                 AS n_alone
        FROM documents JOIN labels USING (doc_id)"""
    ORACLES["cap_audit"] = f"""
        SELECT count(*) AS n,
               count(*) FILTER (WHERE floor(length(text) / 3.5::DOUBLE) > {TOKEN_CAP}) AS n_over
        FROM documents"""


def _selection() -> None:
    ORACLES["dedupe_first"] = with_(*ON_POOL) + """
        SELECT rec_id, db_id, question, sql, bucket FROM pool"""
    ORACLES["dedupe_documents"] = f"""
        SELECT min(doc_id) AS doc_id, source FROM documents
        GROUP BY source, trim(regexp_replace(text, '{ANY_SPACE}+', ' ', 'g'), ' ')"""
    ORACLES["shuffle_topk"] = f"""
        SELECT doc_id, source, {key(SEED, 'doc_id')} AS shuffle_key FROM documents
        ORDER BY shuffle_key, doc_id LIMIT {TOP_K}"""
    ORACLES["shuffle_take"] = with_(CORPUS) + f"""
        SELECT rec_id, source, {key(SEED, 'rec_id')} AS shuffle_key FROM corpus
        ORDER BY shuffle_key, rec_id LIMIT {TAKE}"""
    ORACLES["first_rows"] = with_(CORPUS) + """
        SELECT rec_id, source, question FROM corpus ORDER BY rec_id LIMIT 3"""
    for name, cap in (
        ("quota_fill", CAP), ("quota_binding_cap", BINDING_CAP), ("quota_large_cap", LARGE_CAP)
    ):
        ORACLES[name] = with_(*ON_POOL, quota_ctes(QUOTAS, cap)) + PICKS
    topped_up = with_(*ON_POOL, quota_ctes(HALF_QUOTAS, CAP, SAMPLE))
    ORACLES["quota_topup"] = topped_up + PICKS
    ORACLES["fill_counts"] = topped_up + """
        SELECT bucket, count(*) AS n FROM picks GROUP BY bucket"""
    ORACLES["quota_truncated"] = with_(*ON_POOL, quota_ctes(QUOTAS, CAP)) + (
        f"{PICKS} ORDER BY pick_pass, u, rec_id LIMIT {TRUNCATED}")
    ORACLES["remaining_pool"] = with_(*ON_POOL) + f"""
        SELECT rec_id, bucket FROM pool
        QUALIFY row_number() OVER (ORDER BY u, rec_id) > {TOP_K}"""


def _split() -> None:
    ORACLES["stratified_split"] = with_(*ON_POOL, SPLIT) + """
        SELECT rec_id, source, bucket, split FROM labelled"""
    ORACLES["split_documents"] = with_(split_cte("documents", "lang, source", "doc_id")) + """
        SELECT doc_id, split FROM labelled"""
    ORACLES["split_stats"] = with_(*ON_POOL, SPLIT) + """
        SELECT CASE grouping_id(split, source, bucket) WHEN 7 THEN 'merged' WHEN 5 THEN 'source'
                 WHEN 6 THEN 'bucket' WHEN 3 THEN 'split' ELSE 'split_bucket' END AS dimension,
               split, source, bucket, count(*) AS n
        FROM labelled
        GROUP BY GROUPING SETS ((), (source), (bucket), (split), (split, bucket))"""
    ORACLES["distinct_dbs"] = with_(CORPUS) + """
        SELECT count(DISTINCT db_id) AS distinct_dbs FROM corpus"""
    ORACLES["group_size"] = with_(CORPUS, CLASSIFIED) + """
        SELECT rec_id, source, bucket, count(*) OVER (PARTITION BY source, bucket) AS group_size
        FROM classified"""
    ORACLES["split_union_roundtrip"] = with_(*ON_POOL) + "SELECT rec_id, db_id, sql FROM pool"
    ORACLES["merged_order"] = with_(*ON_POOL, SPLIT) + f"""
        SELECT rec_id, split, row_number() OVER (ORDER BY
          CASE split WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END,
          {key(SEED + 1, 'rec_id')}, rec_id) - 1 AS position
        FROM labelled"""
    ORACLES["merge_sources"] = with_(CORPUS) + f"""
        SELECT source || '|' || rec_id::VARCHAR AS rec_id, source, {bucket('target')} AS bucket,
               db_id AS db
        FROM (SELECT *, {clean('sql_raw')} AS target FROM corpus)"""


def _statistics() -> None:
    def profile(by: str, group: str) -> str:
        return f"""
        SELECT {by}count(*) AS n, floor(median(chars))::BIGINT AS p50,
               list_sort(list(chars))[floor(0.9::DOUBLE * count(*))::BIGINT + 1] AS p90,
               max(chars) AS longest, floor(max(chars) / 3.5::DOUBLE)::BIGINT AS est_max_tokens
        FROM (SELECT source, length(text)::BIGINT AS chars FROM documents) {group}"""

    ORACLES["length_profile"] = profile("", "")
    ORACLES["length_profile_by_source"] = profile("source, ", "GROUP BY source")
    ORACLES["length_preview"] = """
        SELECT list_sort(list(tokens))[101] AS p50, max(tokens) AS longest
        FROM (SELECT floor(length(text) / 3.5::DOUBLE)::BIGINT AS tokens FROM documents
              ORDER BY doc_id LIMIT 200)"""
    flags = tests("target")
    sums = ", ".join(
        f"count(*) FILTER (WHERE {flags[name]}) AS \"{name}\"" for name in FEATURES
    )
    ORACLES["profile_corpus"] = with_(*ON_RECORDS) + f"""
        SELECT source, count(*) AS n, {sums},
               count(*) FILTER (WHERE NOT {breaks('target')}) AS parse_ok,
               floor(median(length(usr)))::BIGINT AS p50,
               list_sort(list(length(usr)))[floor(0.9::DOUBLE * count(*))::BIGINT + 1] AS p90,
               max(length(usr)) AS longest,
               floor(max(length(usr)) / 3.5::DOUBLE)::BIGINT AS est_max_tokens,
               count(DISTINCT db_id) AS distinct_dbs
        FROM records GROUP BY source"""


def _scores() -> None:
    pairs = f"""
        pairs AS (SELECT rec_id, source, bucket, {clean('sql_raw')} AS gold,
                         {unfenced('pred_raw')} AS answer
                  FROM corpus JOIN pred USING (rec_id) JOIN classified USING (rec_id, source)),
        flags AS (SELECT *, NOT {breaks('answer')} AS parse_ok,
                         {norm('gold')} = {norm('answer')} AS em FROM pairs)"""
    base = with_(CORPUS, CLASSIFIED, PRED, pairs)
    ORACLES["score"] = base + f"SELECT {MEASURES} FROM flags"
    ORACLES["score_by_stratum"] = base + f"""
        SELECT source, bucket, {MEASURES} FROM flags GROUP BY source, bucket"""
    draw = " + ".join(f"(u >= {cut})::INT" for cut in POISSON)
    number = "('0x' || substr(md5(rec_id::VARCHAR || '|' || (r // 4)::VARCHAR), 8 * (r % 4) + 1, 8))::BIGINT"
    low = f"CAST(floor(len(%s) * {(1 - 0.95) / 2!r}::DOUBLE) AS BIGINT)"
    ends = ", ".join(
        f"list_sort({c})[{low % c} + 1] AS {name}_low, list_sort({c})[len({c}) - {low % c}] AS {name}_high"
        for c, name in (("parses", "parse"), ("ems", "em"))
    )
    ORACLES["score_by_tier"] = base + f"""
        , drawn AS (SELECT bucket, parse_ok, em, r, {draw} AS w
                    FROM (SELECT *, {number} AS u FROM flags, range({REPLICATES}) t(r)) x),
        rates AS (SELECT bucket, grouping(bucket) = 1 AS is_total, r,
                    sum(w * parse_ok::INT)::DOUBLE / nullif(sum(w), 0) AS parse_rate,
                    sum(w * em::INT)::DOUBLE / nullif(sum(w), 0) AS em_rate
                  FROM drawn GROUP BY GROUPING SETS ((bucket, r), (r))),
        lists AS (SELECT bucket, is_total, list(parse_rate) FILTER (WHERE parse_rate IS NOT NULL) AS parses,
                    list(em_rate) FILTER (WHERE em_rate IS NOT NULL) AS ems FROM rates GROUP BY bucket, is_total),
        plain AS (SELECT bucket, grouping(bucket) = 1 AS is_total, {MEASURES} FROM flags
                  GROUP BY GROUPING SETS ((bucket), ()))
        SELECT p.bucket AS tier, p.is_total, n, parse_ok, em, parse_rate, normalized_em, {ends}
        FROM plain p JOIN lists l ON p.is_total = l.is_total AND p.bucket IS NOT DISTINCT FROM l.bucket"""
    ORACLES["score_samples"] = with_(*ON_RECORDS, PRED) + f"""
        SELECT rec_id AS ord,
               {strip("substr(string_split(usr, 'Question:')[-1], 1, 120)")} AS question,
               target AS gold, {unfenced('pred_raw')} AS pred
        FROM records JOIN pred USING (rec_id) ORDER BY rec_id LIMIT 3"""


def _jobs() -> None:
    ORACLES["jsonl_round_trip"] = with_(*ON_RECORDS) + """
        SELECT row_number() OVER (ORDER BY rec_id) - 1 AS ord, usr, target FROM records"""

    ORACLES["build_subset"] = with_(*ON_POOL, quota_ctes(HALF_QUOTAS, CAP, SAMPLE)) + f"""
        SELECT row_number() OVER (ORDER BY {key(SEED + 1, 'rec_id')}, rec_id) - 1 AS i,
               db_id, bucket, question, rec_id
        FROM picks JOIN (SELECT rec_id, question FROM corpus) USING (rec_id)"""
    merged = f"""
        merged AS (
          SELECT source || '|' || (row_number() OVER (PARTITION BY source ORDER BY rec_id) - 1)
                   AS rec_id, source, {bucket('target')} AS bucket, db_id AS db
          FROM records)"""
    ORACLES["merge_and_split"] = with_(
        *ON_RECORDS, merged, split_cte("merged", "source, bucket", "rec_id")
    ) + f"""
        SELECT rec_id, source, bucket, db, split, row_number() OVER (ORDER BY
          CASE split WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END,
          {key(SEED + 1, 'rec_id')}, rec_id) - 1 AS position
        FROM labelled"""
    ORACLES["score_predictions"] = ORACLES["score"]


def _cases() -> None:
    flags = tests("sql_raw")
    base = with_(CORPUS, CASES)
    ORACLES["case_features"] = base + f"SELECT rec_id, {bucket('sql_raw')} AS bucket, " + ", ".join(
        f"{flags[name]} AS has_{name}" for name in FEATURES) + " FROM cases"
    ORACLES["case_window_audit"] = base + f"""
        SELECT count(*) AS n, count(*) FILTER (WHERE {flags['window']}) AS n_window FROM cases"""
    # sound by construction
    ORACLES["case_structure"] = base + "SELECT rec_id, sound FROM cases"
    ORACLES["case_roles"] = base + """
        SELECT rec_id FROM cases WHERE roles <> ['system', 'user', 'assistant']"""


def _audits() -> None:
    ORACLES["duplicate_audit"] = with_(CORPUS) + f"""
        SELECT min(rec_id) AS first_id, count(*) AS n FROM corpus
        GROUP BY db_id, {norm('sql_raw')} HAVING count(*) > 1"""
    ORACLES["duplicate_documents"] = """
        SELECT min(doc_id) AS first_id, count(*) AS n FROM documents
        GROUP BY text HAVING count(*) > 1"""
    ORACLES["leak_audit"] = """
        SELECT DISTINCT doc_id
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
        WHERE line IN (SELECT unnest(string_split(text, chr(10))) FROM benchmark)"""
    ORACLES["benchmark_leaks"] = r"""
        WITH b AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
        d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
        sized AS (SELECT w, least(len(w), 13) AS n FROM b),
        wanted AS (SELECT DISTINCT n, array_to_string(w[i:i + n - 1], ' ') AS run
                   FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized WHERE n >= 8)),
        own AS (SELECT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS run
                FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                      FROM d, (SELECT DISTINCT n FROM wanted) WHERE len(w) >= n))
        SELECT DISTINCT doc_id FROM own SEMI JOIN wanted USING (n, run)
        UNION SELECT doc_id FROM d WHERE len(w) BETWEEN 1 AND 7 AND w IN (SELECT w FROM b)"""
    ORACLES["split_leak_audit"] = with_(*ON_POOL, SPLIT) + """
        , spread AS (SELECT upper(sql) AS s, string_agg(DISTINCT split, ',' ORDER BY split) AS splits
                     FROM labelled GROUP BY upper(sql) HAVING count(DISTINCT split) > 1)
        SELECT rec_id, split, splits FROM labelled JOIN spread ON upper(sql) = s"""
    ORACLES["split_near_leaks"] = with_(*ON_POOL, SPLIT) + r"""
        , w AS (SELECT rec_id, split, list_sort(list_distinct(regexp_extract_all(
                  lower(question || ' ' || sql), '[\pL\pN_]+|[^\s\pL\pN_]'))) AS words FROM labelled),
        s AS (SELECT DISTINCT split, words FROM w),
        u AS (SELECT DISTINCT words FROM s),
        n AS (SELECT a.words, b.words AS other, len(list_intersect(a.words, b.words)) AS common
              FROM u a JOIN u b ON TRUE),
        found AS (SELECT DISTINCT n.words, s.split FROM n JOIN s ON s.words = n.other
                  WHERE 100 * common >= 80 * (len(n.words) + len(n.other) - common))
        SELECT rec_id, w.split, string_agg(found.split, ',' ORDER BY found.split) AS splits
        FROM w JOIN found ON found.words = w.words AND found.split <> w.split GROUP BY rec_id, w.split"""
    columns = COLUMN_CANDIDATES_SQL.format(results="results").replace("<<", "[").replace(">>", "]")
    ORACLES["result_match_columns"] = with_(
        f"results AS ({COLUMN_RESULTS_SQL.format(lineitem='lineitem')})", f"candidates AS ({columns})"
    ) + """
        , orders AS (SELECT unnest([[1, 2, 3], [1, 3, 2], [2, 1, 3], [2, 3, 1], [3, 1, 2], [3, 2, 1]]) AS o),
        bags AS (SELECT question_id, cand_idx, o, list_sort(list([cells[o[1]], cells[o[2]], cells[o[3]]])) AS bag
                 FROM candidates, orders GROUP BY question_id, cand_idx, o)
        SELECT b.question_id, b.cand_idx, bool_or(b.bag = g.bag) AS matches
        FROM bags b JOIN bags g ON b.question_id = g.question_id AND g.cand_idx = 0 AND g.o = [1, 2, 3]
        WHERE b.cand_idx > 0 GROUP BY b.question_id, b.cand_idx"""
    results = f"""results AS ({RESULTS_SQL.format(lineitem='lineitem')}),
        candidates AS ({CANDIDATES_SQL.format(results='results')}),
        bags AS (SELECT question_id, cand_idx, list_sort(list(row_json)) AS bag
                 FROM candidates GROUP BY question_id, cand_idx)"""
    ORACLES["result_match"] = with_(results) + """
        SELECT b.question_id, b.cand_idx, b.bag = g.bag AS matches
        FROM bags b JOIN bags g ON b.question_id = g.question_id AND g.cand_idx = 0
        WHERE b.cand_idx > 0"""
    ORACLES["vote"] = with_(results) + """
        SELECT question_id, min(cand_idx) AS cand_idx, count(*) AS votes
        FROM bags WHERE cand_idx > 0 GROUP BY question_id, bag
        QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY count(*) DESC, min(cand_idx)) = 1"""
    ORACLES["evidence_attach"] = with_(CORPUS) + """
        SELECT rec_id, question,
               CASE WHEN length(question) % 2 = 0 THEN 'see ' || question END AS evidence
        FROM corpus"""


def _written_jobs() -> None:
    ORACLES["reader_layout_change"] = with_(CORPUS, PRED) + """
        SELECT row_number() OVER (ORDER BY rec_id) - 1 AS ord, length(pred_raw) AS chars FROM pred"""
    numbered = f"""
        numbered AS (
          SELECT source || '|' || (row_number() OVER (PARTITION BY source ORDER BY rec_id) - 1)
                   AS rec_id, source, {bucket('target')} AS bucket, usr, target
          FROM records)"""
    order = f"""CASE split WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END,
          {key(SEED + 1, 'rec_id')}, rec_id"""
    merged = with_(*ON_RECORDS, numbered, split_cte("numbered", "source, bucket", "rec_id"))
    ORACLES["merged_records"] = merged + f"""
        SELECT row_number() OVER (ORDER BY {order}) - 1 AS ord, rec_id, usr, target FROM labelled"""
    ORACLES["named_splits"] = merged + f"""
        SELECT split, row_number() OVER (PARTITION BY split ORDER BY {order}) - 1 AS ord, target
        FROM labelled"""
    answer = "CASE WHEN length(target) % 3 = 0 THEN 'SELECT FROM WHERE' ELSE lower(target) END"
    ORACLES["score_by_manifest"] = merged + f"""
        , flags AS (SELECT source, bucket, NOT {breaks('answer')} AS parse_ok,
                           {norm('target')} = {norm('answer')} AS em
                    FROM (SELECT *, {answer} AS answer FROM labelled WHERE split = 'test'))
        SELECT source, bucket, {MEASURES} FROM flags GROUP BY source, bucket"""
    ORACLES["subset_records"] = with_(
        *ON_RECORDS, CLASSIFIED, POOL, quota_ctes(HALF_QUOTAS, CAP, SAMPLE)
    ) + f"""
        SELECT row_number() OVER (ORDER BY {key(SEED + 1, 'rec_id')}, rec_id) - 1 AS ord,
               usr, sql AS target
        FROM picks JOIN (SELECT rec_id, usr FROM records) USING (rec_id)
                   JOIN (SELECT rec_id, sql FROM classified) USING (rec_id)"""
    ORACLES["clean_job"] = with_(CORPUS) + f"""
        SELECT row_number() OVER (ORDER BY rec_id) - 1 AS ord, {clean('sql_raw')} AS sql,
               count(*) OVER () AS records,
               count(*) FILTER (WHERE ends_with({strip('sql_raw')}, ';')) OVER () AS fixed_semicolons,
               0::BIGINT AS unparseable
        FROM corpus WHERE NOT {breaks('sql_raw')}"""
    ORACLES["profile_paths"] = ORACLES["profile_corpus"].replace("SELECT source, count", "SELECT source AS path, count")
    ORACLES["questions_array"] = with_(CORPUS) + """
        SELECT row_number() OVER (ORDER BY rec_id) - 1 AS ord, db_id, sql_raw AS query, question
        FROM corpus"""


    ORACLES["questions_one_array"] = with_(CORPUS) + r"""
        SELECT row_number() OVER (ORDER BY rec_id) - 1 AS ord, db_id, sql_raw AS query,
               question || ' "}, {" [\" \\' || (rec_id % 3)::VARCHAR || chr(10) || ']}' AS question
        FROM corpus"""


def _appended() -> None:
    ORACLES["quota_fill_appended"] = ORACLES["quota_topup"]
    ORACLES["dedupe_appended"] = ORACLES["dedupe_first"]
    owed = {"test": "greatest(0, share_test - had_test)", "validation": "greatest(0, share_val - had_val)"}
    ORACLES["split_appended"] = with_(*ON_POOL) + f"""
        , h AS (SELECT *, rec_id <= (SELECT floor((min(rec_id) + max(rec_id)) / 2) FROM pool) AS old FROM pool),
        r AS (SELECT *, count(*) OVER (PARTITION BY source, bucket, old) AS part_size,
                count(*) OVER (PARTITION BY source, bucket) AS size,
                row_number() OVER (PARTITION BY source, bucket, old ORDER BY {key(SEED, 'rec_id')}, rec_id) AS rn
              FROM h),
        first AS (SELECT *, {share('part_size', 0.1)} AS k FROM r WHERE old),
        labelled AS (SELECT *, CASE WHEN rn <= k THEN 'test' WHEN rn <= 2 * k THEN 'validation' ELSE 'train' END AS split
                     FROM first),
        had AS (SELECT source, bucket, count(*) FILTER (WHERE split = 'test') AS had_test,
                  count(*) FILTER (WHERE split = 'validation') AS had_val FROM labelled GROUP BY source, bucket),
        later AS (SELECT r.* , {share('size', 0.1)} AS share_test, {share('size', 0.1)} AS share_val,
                    coalesce(had_test, 0) AS had_test, coalesce(had_val, 0) AS had_val
                  FROM r LEFT JOIN had USING (source, bucket) WHERE NOT old)
        SELECT rec_id, source, bucket, split FROM labelled
        UNION ALL SELECT rec_id, source, bucket,
               CASE WHEN rn <= {owed['test']} THEN 'test'
                    WHEN rn <= {owed['test']} + {owed['validation']} THEN 'validation' ELSE 'train' END
        FROM later"""
    cell = "CASE WHEN chars = 0 THEN -1 ELSE CAST(ceil(ln(chars) / ln(1.02::DOUBLE)) AS INT) END"
    middle = "CASE WHEN {0} < 0 THEN 0 ELSE CAST(round(pow(1.02::DOUBLE, {0}) * (2 / 2.02::DOUBLE)) AS BIGINT) END"
    p50, p90 = "list_sort(cells)[(n - 1) // 2 + 1]", "list_sort(cells)[CAST(floor(n * 0.9::DOUBLE) AS BIGINT) + 1]"
    ORACLES["profile_merged"] = f"""
        WITH d AS (SELECT source, lang, length(text) AS chars, {cell.replace('chars', 'length(text)')} AS c FROM documents),
        g AS (SELECT coalesce(source, 'merged') AS source, count(*) AS n, count(DISTINCT lang) AS different,
                list(c) AS cells, max(chars) AS longest FROM d GROUP BY ROLLUP (source))
        SELECT source, n, different, {middle.format(p50)} AS p50, {middle.format(p90)} AS p90, longest FROM g"""


for _part in (_text, _structure, _prompts, _gates, _selection, _split, _statistics, _scores,
              _jobs, _cases, _audits, _written_jobs, _appended):
    _part()
