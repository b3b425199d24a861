"""SQL checks: what each query has to return, from the typed tables (DuckDB)."""

from __future__ import annotations

from tallybook import vocab
from workload import fixtures as fx
from workload.queries import DEFAULT_DATE, FRAGMENTS, LISTED, N_RESULTS


def _q(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def _d(total: str) -> str:
    return f"cast(round({total}, 2) AS double)"


def _sum(value: str) -> str:
    return f"coalesce(sum(cast({value} AS decimal(24,6))), 0)"


TYPED = f"typed AS ({fx.typed_sql()})"
LEDGER = TYPED + """,
ledger AS (SELECT date, description, amount,
                  CASE WHEN amount > 0 THEN 'credit' ELSE 'debit' END AS transaction_type, category
           FROM typed WHERE amount <> 0)"""
# What survives cleaning of the messy rows.
CLEANED = TYPED + """,
cleaned AS (SELECT date, description, amount,
                   CASE WHEN amount > 0 THEN 'credit' ELSE 'debit' END AS transaction_type, category
            FROM typed WHERE amount <> 0 AND damage = '')"""
INDEX = LEDGER + """,
idx AS (SELECT 'txn_' || md5(concat_ws('|', cast(date AS varchar), description,
                                       cast(cast(round(amount * 1000000) AS bigint) AS varchar)))
               || '-' || cast(row_number() OVER (PARTITION BY date, description, amount) AS varchar) AS txn_id,
               * FROM ledger)"""
QUESTIONS = f"questions AS ({fx.questions_sql()})"
GOLDEN = "questions AS (SELECT * FROM (VALUES " + ", ".join(
    f"({_q(c[0])}, {_q(c[1])})" for c in fx.CASES) + ") AS g(question_id, question))"
CASES = "case_list AS (SELECT * FROM (VALUES " + ", ".join(
    f"({_q(c[0])}, {_q(c[3])}, {_q(c[4])}, {_q(c[5])}, {c[6]})" for c in fx.CASES
) + ") AS c(case_id, merchant, category, month, off))"
MONTH_NAME = "list_extract([" + ", ".join(map(_q, vocab.MONTH_NAMES)) + "], {})"
_EDGE_A, _EDGE_B = r"(^|[^\p{L}\p{M}\p{N}_])", r"($|[^\p{L}\p{M}\p{N}_])"


def _re_quote(word: str) -> str:
    return word.replace(".", r"\.")


def _word(column: str, *words: str) -> str:
    pattern = _EDGE_A + "(" + "|".join(map(_re_quote, words)) + ")" + _EDGE_B
    return f"regexp_matches({column}, {_q(pattern)})"


def _plans_sql() -> str:
    """Plans by explicit tests, one per word, over the lower-cased question."""
    low = "lower(question)"
    brands = sorted(vocab.BRANDS, key=len, reverse=True)
    merchant = "CASE " + " ".join(f"WHEN {_word('q', b)} THEN {_q(b)}" for b in brands) + " END"
    categories = "[" + ", ".join(
        f"CASE WHEN {_word('q', *words)} THEN {_q(c)} END" for c, words in vocab.CATEGORY_TRIGGERS.items()
    ) + "]"
    tokens = [[t for t in vocab.MONTH_TOKENS if t[:3] == m[:3].lower()] for m in vocab.MONTH_NAMES]
    numbers = "[" + ", ".join(
        f"CASE WHEN {_word('q', *ts)} THEN {i} END" for i, ts in enumerate(tokens, 1)) + "]"
    every = " OR ".join(f"contains(q, {_q(p)})" for p in vocab.ALL_MONTHS_PHRASES)
    total = " OR ".join(f"contains(q, {_q(p)})" for p in vocab.AGGREGATE_WORDS)
    return f"""
lowered AS (SELECT question_id, question, {low} AS q FROM questions),
named AS (SELECT *, {merchant} AS merchant,
                 CASE WHEN {every} THEN [] ELSE list_filter({numbers}, lambda x: x IS NOT NULL) END AS nums,
                 regexp_extract(question, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])(20[0-9][0-9])($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])', 2) AS yr,
                 CASE WHEN {total} THEN 'aggregate' ELSE 'lookup' END AS intent FROM lowered),
planned AS (SELECT *, CASE WHEN merchant IS NULL THEN list_filter({categories}, lambda x: x IS NOT NULL) ELSE [] END AS cats,
                   CASE WHEN yr <> '' THEN list_transform(nums, lambda n: yr || '-' || lpad(cast(n AS varchar), 2, '0')) ELSE [] END AS ms,
                   CASE WHEN yr <> '' THEN [] ELSE nums END AS mn FROM named),
plans AS (SELECT question_id, question, intent, merchant, cats, ms, mn,
                 (merchant IS NOT NULL OR len(cats) > 0 OR len(nums) > 0) AS has_filter,
                 (intent = 'aggregate' OR merchant IS NOT NULL OR len(cats) > 0 OR len(nums) > 0) AS wants_all,
                 coalesce(nullif(concat_ws('; ',
                   CASE WHEN merchant IS NOT NULL THEN 'merchant contains ''' || merchant || '''' END,
                   CASE WHEN len(cats) > 0 THEN 'category = ' || array_to_string(cats, ', ') END,
                   CASE WHEN len(ms) > 0 THEN 'month = ' || array_to_string(ms, ', ')
                        WHEN len(mn) > 0 THEN 'month = ' || array_to_string(list_transform(mn, lambda n: {MONTH_NAME.format('n')}), ', ') END
                 ), ''), 'no metadata filter (ranked by semantic relevance)') AS scope
          FROM planned)"""


PLANS = _plans_sql()
MATCH = """p.wants_all
  AND (p.merchant IS NULL OR contains(lower(l.description), p.merchant))
  AND (len(p.cats) = 0 OR list_contains(p.cats, l.category))
  AND (len(p.ms) = 0 OR list_contains(p.ms, strftime(l.date, '%Y-%m')))
  AND (len(p.mn) = 0 OR list_contains(p.mn, month(l.date)))"""
CHUNK = """category || ' transaction on ' || strftime(date, '%A, %B %d %Y') || ': ' || description
  || ' — ₹' || format('{:.2f}', abs(amount)) || '. Type: ' || transaction_type || '.'"""


def _buckets(source: str, key: str, text: str) -> str:
    return f"""SELECT k, b, cast(count(*) AS double) AS n FROM (
      SELECT k, CAST('0x' || substr(md5(t), 1, 8) AS bigint) % {vocab.EMBEDDING_DIM} AS b
      FROM (SELECT {key} AS k, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS t FROM {source}))
    GROUP BY k, b"""


_GRID = "CROSS JOIN range(0, {0}) AS r(i)".format(vocab.EMBEDDING_DIM)
VECTORS = f"""SELECT c.txn_id, string_agg(cast(coalesce(cast(cb.n AS int), 0) AS varchar), ',' ORDER BY i) AS embedding
    FROM chunks c {_GRID} LEFT JOIN ({_buckets('chunks', 'txn_id', 'chunk')}) cb ON cb.k = c.txn_id AND cb.b = i GROUP BY c.txn_id"""
# Nearest rows of all lookups, each different question once, with dense vectors.
LOOKUPS = f"""
chunks AS (SELECT txn_id, {CHUNK} AS chunk FROM idx),
asked AS (SELECT DISTINCT question FROM plans WHERE NOT wants_all),
cv AS (SELECT c.txn_id, list(coalesce(cb.n, 0) ORDER BY i) AS v FROM chunks c {_GRID}
       LEFT JOIN ({_buckets('chunks', 'txn_id', 'chunk')}) cb ON cb.k = c.txn_id AND cb.b = i GROUP BY c.txn_id),
qv AS (SELECT a.question, list(coalesce(qb.n, 0) ORDER BY i) AS v FROM asked a {_GRID}
       LEFT JOIN ({_buckets('asked', 'question', 'question')}) qb ON qb.k = a.question AND qb.b = i GROUP BY a.question),
cs AS (SELECT *, list_dot_product(v, v) AS s FROM cv),
qs AS (SELECT *, list_dot_product(v, v) AS s FROM qv),
lookup_dist AS (SELECT question, txn_id, CASE WHEN cs.s * qs.s > 0 THEN round(1 - list_dot_product(cs.v, qs.v) / sqrt(cs.s * qs.s), 9) ELSE 1 END AS distance
                FROM cs CROSS JOIN qs),
lookup_rank AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY distance, txn_id) AS rn FROM lookup_dist),
lookup_sums AS (SELECT question, count(*) AS n, {_sum('CASE WHEN amount < 0 THEN -amount END')} AS spend, {_sum('CASE WHEN amount >= 0 THEN amount END')} AS income
                FROM lookup_rank r JOIN idx l ON l.txn_id = r.txn_id WHERE rn <= {vocab.TOP_K} GROUP BY question)"""
HITS = f"""
complete_hits AS (SELECT p.question_id, l.*, cast(NULL AS double) AS distance, true AS complete
                  FROM idx l JOIN plans p ON {MATCH}),
chunks AS (SELECT txn_id, {CHUNK} AS chunk FROM idx),
cb AS ({_buckets('chunks', 'txn_id', 'chunk')}),
cn AS (SELECT k, sum(n * n) AS s FROM cb GROUP BY k),
qb AS ({_buckets('(SELECT * FROM plans WHERE NOT wants_all)', 'question_id', 'question')}),
qn AS (SELECT k, sum(n * n) AS s FROM qb GROUP BY k),
dots AS (SELECT qb.k AS question_id, cb.k AS txn_id, sum(qb.n * cb.n) AS dot
         FROM qb JOIN cb ON qb.b = cb.b GROUP BY qb.k, cb.k),
dist AS (SELECT d.question_id, d.txn_id, round(1 - d.dot / sqrt(cn.s * qn.s), 9) AS distance
         FROM dots d JOIN cn ON cn.k = d.txn_id JOIN qn ON qn.k = d.question_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, txn_id) AS rn FROM dist),
near_hits AS (SELECT r.question_id, l.*, round(r.distance, 4) AS distance, false AS complete
              FROM ranked r JOIN idx l ON l.txn_id = r.txn_id WHERE rn <= {vocab.TOP_K}),
hits AS (SELECT * FROM complete_hits UNION ALL SELECT * FROM near_hits)"""
GOLDEN_HITS = f"{INDEX}, {GOLDEN}, {PLANS}, {HITS}"
# The different plans of all questions under their own names, and the hits of each.
PLAN_ID = """md5(CASE WHEN wants_all THEN concat_ws('|', 'all', coalesce(merchant, ''), array_to_string(cats, ','), array_to_string(ms, ','), array_to_string(mn, ','))
  ELSE 'near|' || coalesce(question, '') END)"""
ALL_PLANS = QUESTIONS + ", " + PLANS.replace("plans AS (SELECT", "each_plan AS (SELECT") + f""",
asked_plan AS (SELECT question_id, {PLAN_ID} AS plan_id FROM each_plan),
plans AS (SELECT DISTINCT {PLAN_ID} AS question_id, CASE WHEN NOT wants_all THEN coalesce(question, '') END AS question, merchant, cats, ms, mn, wants_all, scope FROM each_plan)"""
ALL_COMPLETE = f"""
complete_hits AS (SELECT p.question_id, l.*, cast(NULL AS double) AS distance, true AS complete
                  FROM idx l JOIN (SELECT * FROM plans WHERE wants_all) p ON {MATCH})"""
ALL_HITS = f"""{INDEX}, {ALL_PLANS}, {LOOKUPS}, {ALL_COMPLETE},
hits AS (SELECT * FROM complete_hits UNION ALL
         SELECT p.question_id, l.*, round(r.distance, 4), false FROM plans p JOIN lookup_rank r ON r.question = p.question AND r.rn <= {vocab.TOP_K}
         JOIN idx l ON l.txn_id = r.txn_id WHERE NOT p.wants_all)"""
COUNTED_HITS = ALL_HITS.replace(f"r.question = p.question AND r.rn <= {vocab.TOP_K}", f"r.question = p.question AND r.rn <= coalesce({N_RESULTS.replace('question', 'p.question')}, {vocab.TOP_K})")
ANSWERS = f"""
sums AS (SELECT question_id, count(*) AS n, {_sum('CASE WHEN amount < 0 THEN -amount END')} AS spend,
                {_sum('CASE WHEN amount >= 0 THEN amount END')} AS income FROM hits GROUP BY question_id),
answers AS (SELECT p.question_id, {_d('coalesce(CASE WHEN spend > 0 THEN spend ELSE income END, 0)')} AS headline_total,
                   {_d('coalesce(spend, 0)')} AS spend_total, {_d('coalesce(income, 0)')} AS income_total,
                   {_d('coalesce(income, 0) - coalesce(spend, 0)')} AS net, coalesce(n, 0) AS count,
                   p.wants_all AS complete, CASE WHEN p.wants_all THEN 'High' ELSE 'Medium' END AS confidence
            FROM plans p LEFT JOIN sums s ON s.question_id = p.question_id),
evidence AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY amount, txn_id) AS rank FROM hits)"""
EXPECTED = """
expected AS (SELECT c.case_id, l.* FROM ledger l JOIN case_list c
             ON (c.merchant IS NULL OR contains(lower(l.description), c.merchant))
            AND (c.category IS NULL OR l.category = c.category)
            AND (c.month IS NULL OR strftime(l.date, '%Y-%m') = c.month))"""
SCORES = f"""
keys AS (SELECT case_id, date, lower(description) AS t, round(abs(amount), 2) AS a, max(w) AS w, max(f) AS f FROM (
           SELECT case_id, date, description, amount, 1 AS w, 0 AS f FROM expected
           UNION ALL SELECT question_id, date, description, amount, 0, 1 FROM hits) GROUP BY 1, 2, 3, 4),
overlap AS (SELECT case_id, cast(sum(w) AS bigint) AS n_expected, cast(sum(f) AS bigint) AS n_retrieved,
                   cast(sum(w * f) AS bigint) AS n_both FROM keys GROUP BY case_id),
truth AS (SELECT case_id, {_d(_sum('abs(amount)'))} AS expected_total FROM expected GROUP BY case_id),
got AS (SELECT question_id AS case_id, {_d(_sum('abs(amount)'))} AS retrieved_total FROM hits GROUP BY 1),
scores AS (
  SELECT c.case_id, coalesce(n_expected, 0) AS n_expected, coalesce(n_retrieved, 0) AS n_retrieved,
         round(CASE WHEN coalesce(n_expected, 0) = 0 THEN 1.0 ELSE n_both / n_expected END, 4) AS recall,
         round(CASE WHEN coalesce(n_retrieved, 0) > 0 THEN n_both / n_retrieved
                    WHEN coalesce(n_expected, 0) = 0 THEN 1.0 ELSE 0.0 END, 4) AS precision,
         coalesce(retrieved_total, 0) AS retrieved_total, coalesce(expected_total, 0) AS expected_total,
         abs(coalesce(retrieved_total, 0) - coalesce(expected_total, 0)) < 0.01 AS total_ok,
         round(coalesce(expected_total, 0) + off, 2) AS hardcoded_total, off < 0.01 AS matches_hardcoded
  FROM case_list c LEFT JOIN overlap o ON o.case_id = c.case_id
  LEFT JOIN truth t ON t.case_id = c.case_id LEFT JOIN got g ON g.case_id = c.case_id)"""
EVAL = f"{GOLDEN_HITS}, {CASES}, {EXPECTED}, {SCORES}"

# Records behind the model responses.
RECORDS = """recs AS (
  SELECT event_id AS image_id, seq, event_type, value, user_id, ts,
    CASE event_type WHEN 'error' THEN 'abc' WHEN 'view' THEN '-' || format('{:,.2f}', value)
                    ELSE format('{:.2f}', value) END AS amount,
    CASE WHEN event_type = 'click' THEN 'shop' || user_id || '@bank' ELSE '@none' END AS upi_id,
    CASE WHEN event_type = 'purchase' THEN ' Corner Shop ' ELSE '' END AS payee_name,
    CASE WHEN event_type = 'view' THEN '' ELSE 'k' || json_extract_string(props, '$.k') END AS utr,
    CASE WHEN event_type = 'view' THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS date,
    CASE WHEN event_type = 'click' THEN 'Credit' ELSE 'debit' END AS type
  FROM events, (VALUES (0), (2)) AS s(seq)
  WHERE seq = 0 OR event_type = 'signup'),
signed AS (
  SELECT image_id, seq, coalesce(nullif(date, ''), '""" + DEFAULT_DATE + """') AS date,
    CASE event_type WHEN 'click' THEN 'shop' || user_id WHEN 'purchase' THEN 'Corner Shop' ELSE '@none' END AS description,
    CASE WHEN event_type = 'click' THEN 1 ELSE -1 END * cast(format('{:.2f}', value) AS double) AS amount, utr
  FROM recs WHERE event_type <> 'error')"""
SHOWN = "CASE WHEN starts_with(description, 'shop') THEN 'Shop' || substr(description, 5) WHEN description = '@none' THEN '@None' ELSE description END"


def _title(chars: str) -> str:
    """Title case letter by letter: upper after every character that is no letter."""
    letter = r"'[\p{Lu}\p{Ll}\p{Lt}]'"
    return f"""array_to_string(list_transform({chars},
      lambda ch, i: CASE WHEN i > 1 AND regexp_matches({chars}[i - 1], {letter}) THEN ch
                         WHEN ch = 'ß' THEN 'Ss' ELSE upper(ch) END), '')"""


def _category_case(column: str) -> str:
    tests = " ".join(
        "WHEN " + " OR ".join(f"contains({column}, {_q(k)})" for k in words) + f" THEN {_q(c)}"
        for c, words in vocab.RULES.items()
    )
    return f"CASE {tests} ELSE 'Uncategorized' END"


TEXTS = """texts AS (SELECT 'documents' AS source, doc_id AS id, text FROM documents
  UNION ALL SELECT 'conversations', conv_id, text FROM conversations
  UNION ALL SELECT 'pages', page_id, html FROM pages)"""
RULE_ROWS = ", ".join(
    f"({i}, {j}, {_q(c)}, {_q(k)})"
    for i, (c, ks) in enumerate(vocab.RULES.items(), 1) for j, k in enumerate(ks)
)
KNN_DIMS = """dims AS (SELECT {label} AS query_id, i, avg(cast(embedding[i] AS double)) AS m
      FROM embeddings, range(1, 65) AS r(i) GROUP BY ALL),
q AS (SELECT query_id, list(m ORDER BY i) AS v FROM dims GROUP BY query_id),
d AS (SELECT query_id, vec_id, label,
             round(1 - list_cosine_similarity(cast(embedding AS double[]), v), 9) AS dist
      FROM embeddings, q WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM d)"""


def _knn(label: str, k: int, where: str = "true") -> str:
    return f"""WITH {KNN_DIMS.format(label=label, where=where)}
SELECT query_id, vec_id, label, round(dist, 4) AS distance, cast(rank AS int) AS rank FROM r WHERE rank <= {k}"""


BASE = f"""WITH {LEDGER},
m AS (SELECT *, date_trunc('month', date) AS mon, CASE WHEN amount > 0 THEN amount ELSE 0 END AS inc,
             CASE WHEN amount < 0 THEN -amount ELSE 0 END AS spe FROM ledger)"""
VIEW = f"""WITH {LEDGER},
v AS (SELECT * FROM ledger WHERE regexp_matches(lower(description), 'pay|amazon')
      AND category IN ('Income', 'Shopping', 'Rent/Housing'))"""


def _answer_texts() -> str:
    said = "format('{:,.2f}', CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice - 5 ELSE o_totalprice END)"
    return f"""a AS (SELECT o_orderkey AS question_id, o_orderstatus AS s, o_totalprice AS expected_total,
      cast(replace({said}, ',', '') AS double) AS said FROM orders)"""


def _raw_kept(condition: str) -> str:
    return f"WITH {TYPED} SELECT * FROM typed WHERE {condition}"


def _markdown(listed: str = "") -> str:
    return f"""WITH {ALL_HITS}, {ANSWERS},
        opening AS (SELECT question_id, list_filter(['**Answer:** ₹' || format('{{:,.2f}}', headline_total) || ' across ' || count ||
            CASE WHEN count = 1 THEN ' transaction.' ELSE ' transactions.' END,
            CASE WHEN spend_total <> 0 AND income_total <> 0 THEN 'Spending ₹' || format('{{:,.2f}}', spend_total) || ' · Income ₹' ||
              format('{{:,.2f}}', income_total) || ' · Net ₹' || format('{{:,.2f}}', net) || '.' END,
            '', '**Transactions used:**', CASE WHEN count = 0 THEN '_None_' END], lambda x: x IS NOT NULL) AS ls FROM answers),
        closing AS (SELECT question_id, ['', '**Confidence:** ' || confidence || ' — computed directly from ' ||
            CASE WHEN complete THEN 'the complete matching set' ELSE 'a relevance-ranked sample' END || ' of transactions (no estimate).'] AS ls FROM answers)
        SELECT question_id AS plan_id, 1 AS section, i - 1 AS position, ls[i] AS line FROM (SELECT question_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM opening)
        UNION ALL SELECT question_id, 3, i - 1, ls[i] FROM (SELECT question_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM closing)
        UNION ALL SELECT question_id, 2, rank - 1, '- `' || cast(date AS varchar) || '` · ' || description || ' · ' ||
          CASE WHEN transaction_type = 'credit' THEN '+' ELSE '−' END || '₹' || format('{{:,.2f}}', abs(amount)) || ' · _' || category || '_' FROM evidence {listed}"""


def all_sql() -> dict[str, str]:
    cleaned_cols = "date, description, amount, transaction_type"
    accent = "description || ' É' AS description"
    cell_doc = "l_orderkey AS doc_id, date, description, amount, CASE WHEN amount > 0 THEN 'credit' ELSE 'debit' END AS transaction_type"
    sql = {
        "src_csv_statement": f"WITH {CLEANED} SELECT {cleaned_cols} FROM cleaned",
        "src_encoding_groups": f"""WITH {TYPED} SELECT lower(l_returnflag) AS feed, l_returnflag <> 'A' AS valid_utf8,
            cast(1 AS bigint) AS n_headers FROM typed GROUP BY 1, 2""",
        "src_mixed_headers": f"WITH {LEDGER} SELECT date, {accent}, amount, transaction_type FROM ledger",
        "cells_headered": f"WITH {TYPED} SELECT {cell_doc} FROM typed WHERE amount <> 0 AND l_orderkey % 5 < 3",
        "cells_positional": f"WITH {TYPED} SELECT {cell_doc} FROM typed WHERE amount <> 0 AND l_orderkey % 5 = 3",
        "cells_rejects": f"""WITH {TYPED} SELECT DISTINCT l_orderkey AS doc_id, 'no usable table' AS reason
            FROM typed WHERE l_orderkey % 5 = 4""",
        "resp_parse_json": f"""WITH {RECORDS} SELECT image_id, cast(CASE WHEN image_id % 3 = 2 AND event_type <> 'signup' THEN 0 ELSE seq END AS int) AS seq,
            amount, upi_id, payee_name, utr, date, type FROM recs""",
        "resp_description": f"""WITH {RECORDS} SELECT image_id, cast(seq AS int) AS seq,
            CASE event_type WHEN 'click' THEN 'shop' || user_id WHEN 'purchase' THEN 'Corner Shop' ELSE '@none' END AS description FROM recs""",
        "resp_to_ledger": f"""WITH {RECORDS} SELECT cast(date AS date) AS date, {SHOWN} AS description, amount,
            CASE WHEN amount > 0 THEN 'credit' ELSE 'debit' END AS transaction_type, image_id, cast(seq AS int) AS seq, utr FROM signed""",
        "resp_dedupe_utr": f"""WITH {RECORDS}, n AS (SELECT *, row_number() OVER (PARTITION BY image_id, utr ORDER BY seq) AS a,
              row_number() OVER (PARTITION BY utr ORDER BY image_id, seq) AS b FROM signed)
            SELECT image_id, cast(seq AS int) AS seq, date, description, amount, utr, 'image' AS scope FROM n WHERE a = 1 OR utr = ''
            UNION ALL
            SELECT image_id, cast(seq AS int), date, description, amount, utr, 'global' FROM n WHERE b = 1 OR utr = ''""",
        "ledger_union": f"""WITH {CLEANED}, {RECORDS}, n AS (SELECT *, row_number() OVER (PARTITION BY image_id, utr ORDER BY seq) AS a FROM signed)
            SELECT {cleaned_cols}, cast(NULL AS bigint) AS image_id, cast(NULL AS varchar) AS utr FROM cleaned
            UNION ALL SELECT cast(date AS date), {SHOWN}, amount, CASE WHEN amount > 0 THEN 'credit' ELSE 'debit' END, image_id, utr
            FROM n WHERE a = 1 OR utr = ''""",
        "sink_roundtrip": f"WITH {LEDGER} SELECT *, 'csv' AS sink FROM ledger UNION ALL SELECT *, 'parquet' FROM ledger",
        "index_write_read": f"""WITH {INDEX}, chunks AS (SELECT txn_id, {CHUNK} AS chunk FROM idx) SELECT txn_id, date, description, amount, transaction_type, category,
            strftime(date, '%Y-%m') AS month, strftime(date, '%B %Y') AS month_name, cast(month(date) AS int) AS month_num,
            cast(year(date) AS int) AS year, abs(amount) AS abs_amount, chunk, lower(description) AS description_lc, embedding
            FROM (SELECT *, {CHUNK} AS chunk FROM idx) JOIN ({VECTORS}) USING (txn_id)""",
        "index_refresh": f"""WITH {LEDGER}, m AS (SELECT strftime(date, '%Y-%m') AS m, cast(year(date) AS int) AS year, cast(month(date) AS int) AS month_num, count(*) AS n FROM ledger GROUP BY 1, 2, 3)
            SELECT year, month_num, CASE m WHEN '1998-01' THEN 'added' WHEN '2000-02' THEN 'changed' WHEN '1996-05' THEN 'removed' ELSE 'kept' END AS action,
              CASE WHEN m = '1996-05' THEN 0 ELSE n END AS n_rows, CASE WHEN m = '2000-02' THEN n ELSE 0 END AS n_again FROM m""",
        "ledger_fingerprint": f"""WITH {LEDGER} SELECT count(*) AS n_rows, {_d(_sum('amount'))} AS amount_sum,
            min(date) AS first_date, max(date) AS last_date FROM ledger""",
        "norm_aliases": f"""WITH {TYPED}, t AS (SELECT trim(CASE WHEN damage = 'blank' THEN ' ' WHEN l_suppkey % 3 = 0 THEN upper(description)
              WHEN l_suppkey % 3 = 1 THEN lower(description) ELSE replace(description, ' ', '   ') END) AS text,
              damage <> 'date' AND l_linenumber % 3 = 1 AS named_month,
              damage <> 'amount' AND NOT (l_suppkey % 3 = 0 AND amount < 0) AS symbol FROM typed)
            SELECT text, named_month, count(*) AS n, count(*) FILTER (symbol) AS n_symbol FROM t GROUP BY 1, 2""",
        "norm_split_amount": f"""WITH {TYPED} SELECT strftime(date, '%Y-%m-%d 00:00:00') AS date, description, amount FROM typed""",
        "norm_dates": f"WITH {TYPED} SELECT date, count(*) AS n FROM typed WHERE damage <> 'date' GROUP BY 1",
        "norm_amounts": f"WITH {TYPED} SELECT amount, count(*) AS n FROM typed WHERE damage <> 'amount' GROUP BY 1",
        "norm_descriptions": f"""WITH {TYPED}, d AS (SELECT CASE WHEN damage = 'blank' THEN '' ELSE description END AS description FROM typed
              UNION ALL SELECT {_title("cs")} FROM (SELECT string_split(lower(trim(regexp_replace(text, '[\\s\\x1c-\\x1f\\p{{Z}}]+', ' ', 'g'))), '') AS cs FROM documents))
            SELECT description, count(*) AS n FROM d GROUP BY 1""",
        "norm_txn_type": f"""WITH {TYPED} SELECT description, CASE WHEN amount > 0 THEN 'credit' ELSE 'debit' END AS transaction_type,
            count(*) AS n, min(amount) AS low, max(amount) AS high FROM typed GROUP BY 1, 2""",
        "norm_drop_non_txn": f"WITH {TYPED} SELECT date, description, amount FROM typed WHERE amount <> 0 AND damage <> 'blank'",
        "clean_ledger": f"WITH {CLEANED} SELECT {cleaned_cols} FROM cleaned",
        "clean_rejects": f"""WITH {TYPED} SELECT CASE WHEN damage = 'date' THEN 'unreadable date' WHEN damage = 'amount' THEN 'unreadable amount'
              WHEN amount = 0 THEN 'zero amount' ELSE 'blank description' END AS reason, count(*) AS n_rows
            FROM typed WHERE damage <> '' OR amount = 0 GROUP BY 1""",
        "clean_observed": f"""WITH {TYPED}, judged AS (SELECT CASE WHEN damage = 'date' THEN 'unreadable date'
              WHEN damage = 'amount' THEN 'unreadable amount' WHEN amount = 0 THEN 'zero amount'
              WHEN damage <> '' THEN 'blank description' ELSE 'kept' END AS reason FROM typed),
            names AS (SELECT unnest(['unreadable date', 'unreadable amount', 'zero amount', 'blank description', 'kept', 'rows']) AS reason)
            SELECT reason, (SELECT count(*) FROM judged AS j WHERE n.reason IN (j.reason, 'rows')) AS n_observed,
              (SELECT count(*) FROM judged AS j WHERE j.reason = 'kept') AS n_written FROM names AS n""",
        "ledger_filter": f"""WITH {LEDGER} SELECT * FROM ledger WHERE (contains(lower(description), 'amazon') OR starts_with(lower(description), 'pvr'))
            AND category IN ('Shopping', 'Entertainment') AND transaction_type = 'debit'""",
        "where_metadata": f"""WITH {LEDGER} SELECT date, description, amount, category, strftime(date, '%Y-%m') AS month,
            cast(month(date) AS int) AS month_num FROM ledger WHERE category IN ('Groceries', 'Transport') AND month(date) IN (1, 2)""",
        "where_merchant": f"WITH {LEDGER} SELECT * FROM ledger WHERE contains(lower(description), 'amazon')",
        "ledger_metadata": f"""WITH {LEDGER} SELECT *, strftime(date, '%Y-%m') AS month, strftime(date, '%B %Y') AS month_name,
            cast(month(date) AS int) AS month_num, cast(year(date) AS int) AS year, abs(amount) AS abs_amount FROM ledger""",
        "chunk_text": f"WITH {LEDGER} SELECT {CHUNK} AS chunk FROM ledger",
        "categorize_case": f"WITH {TEXTS} SELECT source, id, {_category_case('lower(text)')} AS category FROM texts",
        "categorize_rules_table": f"""WITH {TEXTS}, rules AS (SELECT * FROM (VALUES {RULE_ROWS}) AS r(p, j, category, keyword)),
            hit AS (SELECT t.source, t.id, md5(t.text) AS h, min(p) AS p FROM texts t JOIN rules r ON contains(lower(t.text), r.keyword) GROUP BY 1, 2, 3)
            SELECT t.source, t.id, coalesce((SELECT DISTINCT category FROM rules WHERE rules.p = hit.p), 'Uncategorized') AS category
            FROM texts t LEFT JOIN hit ON hit.source = t.source AND hit.id = t.id AND hit.h = md5(t.text)""",
        "categorize_ledger": f"WITH {CLEANED} SELECT {cleaned_cols}, category FROM cleaned",
        "category_distribution": f"WITH {LEDGER} SELECT category, count(*) AS txn_count FROM ledger GROUP BY 1",
        "uncategorized_review": f"""WITH {LEDGER} SELECT description, count(*) AS txn_count, min(date) AS first_date, max(date) AS last_date
            FROM ledger WHERE category = 'Uncategorized' GROUP BY 1""",
        "rules_shadowed": f"""WITH {LEDGER}, {TEXTS}, rules AS (SELECT * FROM (VALUES {RULE_ROWS}) AS r(p, j, category, keyword)),
            d AS (SELECT lower(t) AS t, count(*) AS n FROM (SELECT description AS t FROM ledger UNION ALL SELECT text FROM texts) GROUP BY 1),
            hit AS (SELECT d.t, d.n, r.p, r.keyword, row_number() OVER (PARTITION BY d.t ORDER BY r.p, r.category, r.keyword) AS k
                    FROM d JOIN rules r ON contains(d.t, r.keyword)),
            used AS (SELECT p, keyword, sum(n) AS n_rows, sum(CASE WHEN k = 1 THEN n ELSE 0 END) AS n_decided FROM hit GROUP BY 1, 2)
            SELECT cast(r.p AS int) AS priority, r.category, r.keyword,
              (SELECT min_by(e.category, e.p) FROM rules e WHERE e.p < r.p AND contains(r.keyword, e.keyword)) AS shadowed_by,
              cast(coalesce(n_rows, 0) AS bigint) AS n_rows, cast(coalesce(n_decided, 0) AS bigint) AS n_decided
            FROM rules r LEFT JOIN used u ON u.p = r.p AND u.keyword = r.keyword""",
        "rule_spot_check": f"""WITH {LEDGER}, f AS (SELECT * FROM (VALUES {', '.join(f'({_q(x)})' for x in FRAGMENTS)}) AS f(fragment)),
            m AS (SELECT f.fragment, l.date, l.description, l.category, row_number() OVER (PARTITION BY f.fragment ORDER BY l.date, l.description, l.category) AS k
                  FROM ledger l JOIN f ON contains(lower(l.description), lower(f.fragment)))
            SELECT f.fragment, m.date, coalesce(m.description, f.fragment) AS description,
              coalesce(m.category, {_category_case('lower(f.fragment)')}) AS category, m.date IS NOT NULL AS in_data
            FROM f LEFT JOIN m ON m.fragment = f.fragment AND m.k = 1""",
        "retrieve_complete": f"WITH {INDEX}, {ALL_PLANS}, {ALL_COMPLETE} SELECT question_id AS plan_id, * EXCLUDE (question_id, distance) FROM complete_hits",
        "retrieve_batch": f"WITH {ALL_HITS} SELECT question_id AS plan_id, * EXCLUDE (question_id) FROM hits",
        "knn_topk": _knn("0", vocab.TOP_K),
        "knn_join": _knn("label", vocab.TOP_K),
        "knn_filtered": _knn("label", 5, "label IN (1, 2, 3)"),
        "knn_lsh": f"""SELECT vec_id AS query_id, (SELECT least(count(*), {vocab.TOP_K}) FROM embeddings) AS n_found, true AS recall_ok, true AS distances_exact
            FROM embeddings WHERE vec_id % 100 = 0""",
        "embed_chunks": f"""WITH {INDEX}, chunks AS (SELECT txn_id, {CHUNK} AS chunk FROM idx), cb AS ({_buckets('chunks', 'txn_id', 'chunk')}),
            full_rows AS (SELECT c.txn_id, c.chunk, i, coalesce(cast(cb.n AS int), 0) AS n FROM chunks c CROSS JOIN range(0, {vocab.EMBEDDING_DIM}) AS r(i)
                          LEFT JOIN cb ON cb.k = c.txn_id AND cb.b = i)
            SELECT chunk, string_agg(cast(n AS varchar), ',' ORDER BY i) AS embedding FROM full_rows GROUP BY txn_id, chunk""",
        "eval_expected_rows": f"WITH {LEDGER}, {CASES}, {EXPECTED} SELECT * FROM expected",
        "eval_key_join": f"WITH {EVAL} SELECT * FROM overlap",
        "answer_confidence": f"WITH {ALL_HITS}, {ANSWERS} SELECT q.question_id, q.plan_id, a.* EXCLUDE (question_id) FROM answers a JOIN asked_plan q ON q.plan_id = a.question_id",
        "answer_evidence": f"WITH {ALL_HITS}, {ANSWERS} SELECT question_id AS plan_id, rank, txn_id, date, description, amount FROM evidence",
        "answer_totals": f"""WITH {INDEX}, {QUESTIONS}, {PLANS}, {LOOKUPS},
            cube AS (SELECT description, category, date_trunc('month', date) AS date, count(*) AS n, {_sum('CASE WHEN amount < 0 THEN -amount END')} AS spend,
                     {_sum('CASE WHEN amount >= 0 THEN amount END')} AS income FROM ledger GROUP BY 1, 2, 3),
            kinds AS (SELECT DISTINCT merchant, cats, ms, mn, wants_all FROM plans WHERE wants_all),
            sums AS (SELECT p.merchant, p.cats, p.ms, p.mn, sum(l.n) AS n, sum(l.spend) AS spend, sum(l.income) AS income
                     FROM cube l JOIN kinds p ON {MATCH} GROUP BY 1, 2, 3, 4)
            SELECT p.question_id, {_d('coalesce(CASE WHEN spend > 0 THEN spend ELSE income END, 0)')} AS headline_total,
              {_d('coalesce(spend, 0)')} AS spend_total, {_d('coalesce(income, 0)')} AS income_total,
              {_d('coalesce(income, 0) - coalesce(spend, 0)')} AS net, cast(coalesce(n, 0) AS bigint) AS count,
              true AS complete, 'High' AS confidence
            FROM plans p LEFT JOIN sums s ON p.merchant IS NOT DISTINCT FROM s.merchant AND p.cats = s.cats AND p.ms = s.ms AND p.mn = s.mn
            WHERE p.wants_all
            UNION ALL SELECT p.question_id, {_d('coalesce(CASE WHEN spend > 0 THEN spend ELSE income END, 0)')}, {_d('coalesce(spend, 0)')},
              {_d('coalesce(income, 0)')}, {_d('coalesce(income, 0) - coalesce(spend, 0)')}, cast(coalesce(n, 0) AS bigint), false, 'Medium'
            FROM plans p LEFT JOIN lookup_sums s ON s.question = p.question WHERE NOT p.wants_all""",
        "answer_markdown": _markdown(),
        "answer_markdown_limited": _markdown(f"WHERE rank <= {LISTED}"),
        "answer_counted": f"WITH {COUNTED_HITS}, {ANSWERS} SELECT question_id AS plan_id, * EXCLUDE (question_id) FROM answers",
        "prompt_context": f"""WITH {ALL_HITS}, {ANSWERS},
            listed AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN complete THEN amount ELSE distance END, txn_id) AS rank FROM evidence),
            opening AS (SELECT a.question_id, CASE WHEN a.count = 0 THEN ['No relevant transactions found.'] ELSE
              [CASE WHEN a.complete THEN 'RETRIEVED TRANSACTIONS — the COMPLETE set matching your filter (' || a.count || ' transactions).'
                    ELSE 'RETRIEVED TRANSACTIONS (' || a.count || ' most relevant to your question):' END,
               'Filter applied: ' || p.scope, ''] END AS ls FROM answers a JOIN plans p ON p.question_id = a.question_id),
            closing AS (SELECT question_id, CASE WHEN complete THEN ['', 'Note: This is the full set of transactions matching the filter above.',
                'You may compute exact totals from it.'] ELSE ['', 'Note: These are the transactions the retrieval system judged most',
                'relevant to your question. This may NOT be the complete set, so do', 'not assume a total over these is exhaustive unless the question is',
                'about these specific rows.'] END AS ls FROM answers WHERE count > 0)
            SELECT question_id AS plan_id, 1 AS section, i - 1 AS position, ls[i] AS line FROM (SELECT question_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM opening)
            UNION ALL SELECT question_id, 3, i - 1, ls[i] FROM (SELECT question_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM closing)
            UNION ALL SELECT question_id, 2, rank - 1, '  [' || lpad(cast(rank AS varchar), cast(greatest(2, len(cast(rank AS varchar))) AS int), '0') || '] ' || cast(date AS varchar) || '  |  ' ||
              rpad(description, cast(greatest(45, len(description)) AS int), ' ') || '  |  ₹' || format('{{:>10}}', format('{{:,.2f}}', abs(amount))) || '  |  ' || category || '  |  ' || transaction_type
            FROM listed""",
        "category_summary": f"""{BASE}, c AS (SELECT category, {_sum('amount')} AS total, count(*) AS txn_count FROM ledger GROUP BY 1),
            b AS (SELECT abs(sum(total)) AS base FROM c WHERE category NOT IN ('Income', 'Savings/Transfer')),
            p AS (SELECT category, {_d('total')} AS total_amount, txn_count,
              CASE WHEN category NOT IN ('Income', 'Savings/Transfer') AND total < 0 AND base > 0 THEN round(cast(-total AS double) / cast(base AS double) * 100, 1) END AS pct FROM c, b)
            SELECT *, coalesce(format('{{:.1f}}%', pct), '—') AS pct_of_spending FROM p""",
        "statement_summary": f"""{BASE} SELECT cast(count(*) AS bigint) AS n_transactions, min(date) AS first_date, max(date) AS last_date,
            count(*) FILTER (amount > 0) AS n_credits, {_d(_sum('inc'))} AS total_credits, count(*) FILTER (amount < 0) AS n_debits,
            {_d(_sum('spe'))} AS total_debits, {_d(_sum('amount'))} AS net FROM m""",
        "monthly_breakdown": f"""{BASE} SELECT strftime(date, '%Y-%m') AS month, count(*) AS transactions, {_d(_sum('amount'))} AS net_flow,
            {_d(_sum('spe'))} AS total_spent, {_d(_sum('inc'))} AS total_income FROM m GROUP BY 1""",
        "kpi_cards": f"""{BASE} SELECT count(*) AS n_transactions, count(*) FILTER (amount > 0) AS n_credits, count(*) FILTER (amount < 0) AS n_debits,
            {_d(_sum('inc'))} AS income, {_d(_sum('spe'))} AS spending, {_d(_sum('amount'))} AS net,
            round(cast({_sum('spe')} AS double) / greatest(count(DISTINCT mon), 1), 2) AS avg_spend_per_month,
            greatest(count(DISTINCT mon), 1) AS n_months, min(date) AS first_date, max(date) AS last_date FROM m""",
        "spend_by_category": f"""{BASE}, c AS (SELECT category, {_sum('spe')} AS s FROM m GROUP BY 1)
            SELECT category, {_d('s')} AS spent, round(cast(s AS double) / cast((SELECT sum(s) FROM c) AS double) * 100, 1) AS pct FROM c WHERE s > 0""",
        "monthly_cash_flow": f"""{BASE} SELECT cast(mon AS date) AS month, {_d(_sum('inc'))} AS income, {_d(_sum('spe'))} AS spending,
            {_d(_sum('amount'))} AS net, strftime(mon, '%b %Y') AS month_label FROM m GROUP BY mon""",
        "category_trend": f"""{BASE} SELECT cast(mon AS date) AS month, category, {_d(_sum('spe'))} AS spent FROM m WHERE amount < 0 GROUP BY 1, 2""",
        "ledger_domains": f"""{BASE} SELECT DISTINCT 'category' AS kind, category AS value FROM m
            UNION ALL SELECT DISTINCT 'month', strftime(date, '%Y-%m') FROM m""",
        "top_merchants": f"""{BASE} SELECT description, {_d(_sum('spe'))} AS spent FROM m WHERE amount < 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
        "filtered_totals": f"""{VIEW} SELECT {_d(_sum('CASE WHEN amount < 0 THEN -amount END'))} AS debits,
            {_d(_sum('CASE WHEN amount > 0 THEN amount END'))} AS credits, count(*) AS n_rows FROM v""",
        "view_month_groups": f"""{VIEW} SELECT cast(date_trunc('month', date) AS date) AS month, count(*) AS n_rows,
            {_d(_sum('CASE WHEN amount < 0 THEN -amount END'))} AS spent, min(strftime(date, '%B %Y')) AS month_name FROM v GROUP BY 1""",
        "ledger_head": f"""WITH {LEDGER} SELECT date, substr(description, 1, 44) AS description, amount, transaction_type
            FROM ledger ORDER BY date, ledger.description, amount LIMIT 10""",
        "eval_truth_total": f"WITH {LEDGER}, {CASES}, {EXPECTED} SELECT case_id, {_d(_sum('abs(amount)'))} AS expected_total FROM expected GROUP BY 1",
        "eval_retrieval_scores": f"WITH {EVAL} SELECT * FROM scores",
        "eval_case_passed": f"WITH {EVAL} SELECT case_id, recall, total_ok, recall >= 0.999 AND total_ok AS passed FROM scores",
        "eval_report": f"""WITH {EVAL}, p AS (SELECT recall, recall >= 0.999 AND total_ok AS passed FROM scores)
            SELECT count(*) FILTER (passed) AS passed, count(*) AS total, bool_and(passed) AS ok, round(avg(recall), 4) AS mean_recall FROM p""",
        "eval_run": f"""WITH {EVAL} SELECT *, hardcoded_total AS answer_total, matches_hardcoded AS answer_ok,
            recall >= 0.999 AND total_ok AND matches_hardcoded AS passed FROM scores""",
        "text_rupee_amounts": f"""WITH {_answer_texts()} SELECT question_id, cast(i AS int) AS place, amount FROM (
            SELECT question_id, 0 AS i, said AS amount FROM a WHERE s = 'F' UNION ALL SELECT question_id, 1, 1.0 FROM a WHERE s = 'F'
            UNION ALL SELECT question_id, 2, 99999999.0 FROM a WHERE s = 'F' UNION ALL SELECT question_id, 0, 0.01 FROM a WHERE s = 'O'
            UNION ALL SELECT question_id, 1, said FROM a WHERE s = 'O' UNION ALL SELECT question_id, 2, 0.5 FROM a WHERE s = 'O')""",
        "text_answer_total": f"""WITH {_answer_texts()} SELECT question_id,
            CASE s WHEN 'F' THEN said WHEN 'O' THEN greatest(said, 0.5) END AS answer_total FROM a""",
        "text_answer_matches": f"""WITH {_answer_texts()} SELECT question_id, CASE s WHEN 'F' THEN said WHEN 'O' THEN greatest(said, 0.5) END AS answer_total,
            s IN ('F', 'O') AND abs(said - expected_total) <= 0.0100001 AS matches FROM a""",
        "plan_merchant": f"WITH {QUESTIONS}, {PLANS} SELECT question_id, merchant FROM plans",
        "plan_months": f"""WITH {QUESTIONS}, {PLANS} SELECT question_id, array_to_string(ms, ',') AS months,
            array_to_string(list_transform(mn, lambda n: cast(n AS varchar)), ',') AS month_nums FROM plans""",
        "plan_intent": f"WITH {QUESTIONS}, {PLANS} SELECT question_id, intent FROM plans",
        "plan_questions": f"""WITH {QUESTIONS}, {PLANS} SELECT question_id, intent, merchant, array_to_string(cats, ',') AS categories,
            array_to_string(ms, ',') AS months, array_to_string(list_transform(mn, lambda n: cast(n AS varchar)), ',') AS month_nums, has_filter, wants_all FROM plans""",
        "plan_scope": f"WITH {QUESTIONS}, {PLANS} SELECT question_id, scope FROM plans",
        "plan_vocab_check": f"""WITH {QUESTIONS} SELECT category, trigger_word AS trigger,
              (SELECT count(*) FROM questions WHERE {_word('lower(question)', 'trip')} AND trigger_word = 'trip'
                 OR {_word('lower(question)', 'gift')} AND trigger_word = 'gift') AS n_questions
            FROM (VALUES ('Travel', 'trip'), ('Gifts', 'gift')) AS t(category, trigger_word)""",
    }
    all_categories = "[" + ", ".join(
        f"CASE WHEN {_word('lower(question)', *words)} THEN {_q(c)} END" for c, words in vocab.CATEGORY_TRIGGERS.items()) + "]"
    sql["plan_categories"] = f"""WITH {QUESTIONS} SELECT question_id,
        array_to_string(list_filter({all_categories}, lambda x: x IS NOT NULL), ',') AS categories FROM questions"""
    return sql
