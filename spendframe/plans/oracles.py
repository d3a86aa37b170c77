"""The same queries as SQL for DuckDB, over the same tables."""

from __future__ import annotations

from spendframe.functions.taxonomy import OTHER, TAXONOMY
from spendframe.functions.text import FILE_KINDS, OTHER_FILES
from spendframe.functions.values import CURRENCY_LABELS, CURRENCY_SYMBOLS, NA_SPELLINGS
from spendframe.plans.queries import OWN_TAXONOMY, PERIOD, PRICE
from spendframe.plans.views import INVENTORY_SQL, LEDGER_SQL, OUTPUT_SQL


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return ", ".join(_text(value) for value in values)


def _four(expression: str) -> str:
    return f"round({expression} + 1e-9, 4)"


def _two(expression: str) -> str:
    return f"round_even(({expression}) * 100, 0) / 100"


def _settled(expression: str) -> str:
    return f"round_even(({expression}) * 1e6, 0) / 1e6"


def _plain(expression: str) -> str:
    return f"cast({expression} AS varchar)"


def _category(taxonomy: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(
        f"WHEN regexp_matches(lower(\"Desc\"), {_text(chr(92) + 'b(' + '|'.join(words) + ')' + chr(92) + 'b')})"
        f" THEN {_text(name)}"
        for name, words in taxonomy.items()
    ) + f" ELSE {_text(OTHER)} END"


_CATEGORY = _category(TAXONOMY)

_RANK = "CASE " + " ".join(
    f"WHEN contains(lower(raw_amt), {_text(symbol.lower())}) THEN {index}"
    for index, symbol in enumerate(CURRENCY_SYMBOLS)
) + " END"

_SYMBOL = "CASE min(rank) " + " ".join(
    f"WHEN {index} THEN {_text(symbol)}" for index, symbol in enumerate(CURRENCY_SYMBOLS)
) + " ELSE '₹' END"

_AMOUNT = r"coalesce(try_cast(regexp_replace(raw_amt, '[^0-9.\-]', '', 'g') AS double), 0)"

_FORMATS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%m/%d/%y", "%m/%d/%Y", "%m-%d-%Y", "%Y.%m.%d", "%Y%m%dT%H%M%S",
            "%d %b %y", "Mon, %d %b %Y", "%b %Y", "%m/%d/%Y %I:%M %p", "%Y-%m", "%b %d, %Y"]
_DATE = "coalesce(" + ", ".join(f"""try_strptime("Date", '{style}')""" for style in _FORMATS) + """,
  try_strptime("Date", '%Y-%m-%dT%H:%M:%S+02') - INTERVAL 2 HOUR)"""

LEDGER = f"""
WITH led AS ({LEDGER_SQL.format(S="varchar")}),
known AS (SELECT event_id, user_id, value,
  CASE WHEN raw_date NOT IN ({_list(NA_SPELLINGS)}) THEN raw_date END AS "Date",
  CASE WHEN raw_desc NOT IN ({_list(NA_SPELLINGS)}) THEN raw_desc END AS raw_desc,
  CASE WHEN raw_amt NOT IN ({_list(NA_SPELLINGS)}) THEN raw_amt END AS raw_amt FROM led),
clean AS (SELECT event_id, user_id, value, raw_desc, raw_amt, "Date",
  CASE WHEN raw_desc IS NULL OR trim(raw_desc) = '' THEN 'Unknown' ELSE raw_desc END AS "Desc",
  {_AMOUNT} AS "Amt", {_RANK} AS rank FROM known),
ledger AS (SELECT *, {_CATEGORY} AS "Category", {_DATE} AS date_ts FROM clean)
"""

_DAYS = "CASE WHEN date_sub('day', min(date_ts), max(date_ts)) > 0 THEN date_sub('day', min(date_ts), max(date_ts)) ELSE 30 END"


def _metrics(keys: str) -> str:
    """CTEs up to ``metrics``: one row per ledger; ``keys`` is a column, or a constant."""
    return LEDGER + f""",
rows_ AS (SELECT *, {keys} AS k FROM ledger),
base AS (SELECT k, count(*) AS n, {_settled('sum("Amt")')} AS total, avg("Amt") AS mean,
  stddev_samp("Amt") AS std, max("Amt") AS highest,
  coalesce(min("Amt") FILTER (WHERE "Amt" > 0), 0) AS lowest, {_DAYS} AS days,
  {_SYMBOL} AS currency FROM rows_ GROUP BY k),
cats AS (SELECT k, "Category" AS cat, {_settled('sum("Amt")')} AS amt,
  row_number() OVER (PARTITION BY k ORDER BY {_settled('sum("Amt")')} DESC, "Category") AS place
  FROM rows_ GROUP BY k, "Category"),
tops AS (SELECT k, max(cat) FILTER (WHERE place = 1) AS top_category,
  max(amt) FILTER (WHERE place = 1) AS top_amount,
  max(amt) FILTER (WHERE place = 2) AS second_amount FROM cats GROUP BY k),
odd AS (SELECT k, count(*) AS anomalies FROM rows_ JOIN base USING (k)
  WHERE "Amt" > mean + 2.5 * std GROUP BY k),
freq AS (SELECT k, min("Desc") AS habit FROM (SELECT k, "Desc" FROM rows_
  GROUP BY k, "Desc" HAVING count(*) >= 3) GROUP BY k),
metrics AS (SELECT base.*, top_category, top_amount, habit,
  CASE WHEN total > 0 THEN top_amount / total * 100 ELSE 0 END AS top_percent,
  CASE WHEN second_amount > 0 THEN top_amount / second_amount ELSE 0 END AS ratio,
  coalesce(anomalies, 0) AS anomalies, total / days AS burn, total / days * 30 AS projection,
  greatest(10, least(100, 100 - CASE WHEN total > 0 AND top_amount / total > 0.5 THEN 20 ELSE 0 END
    - 5 * coalesce(anomalies, 0))) AS score
  FROM base LEFT JOIN tops USING (k) LEFT JOIN odd USING (k) LEFT JOIN freq USING (k))
"""


def _prediction(keys: str, shown: str) -> str:
    return _metrics(keys) + f"""
SELECT {shown}{_two('burn')} AS burn_rate, {_two('projection')} AS projected,
  CASE WHEN {PRICE} < projection * 0.5 THEN 'Affordable' ELSE 'Risky' END AS status,
  currency, score, n AS transaction_count FROM metrics"""


_LABEL = "CASE currency " + " ".join(
    f"WHEN {_text(sign)} THEN {_text(text)}" for sign, text in CURRENCY_LABELS.items()
) + " ELSE currency END"


def _report(keys: str, shown: str) -> str:
    percent = f"printf('%.1f', {_settled('top_percent')})"
    lines = [
        # section, order, condition, label, value
        (0, 1, "true", "'Title'", "'FINANCIAL INTELLIGENCE REPORT'"),
        (0, 2, "true", "'Generated Period'", _text(PERIOD)),
        (0, 3, "true", "'Financial Health Score'", "score || ' / 100'"),
        (0, 4, "true", "'Score Band'",
         "CASE WHEN score >= 80 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'poor' END"),
        (0, 5, "true", "'Heading'", "'EXECUTIVE SUMMARY'"),
        (0, 6, "true", "'Total Transactions'", "n || ''"),
        (0, 7, "true", "'Daily Burn Rate'", f"label || {_plain(_two('burn'))}"),
        (0, 8, "true", "'Monthly Projection'", f"label || {_plain(_two('projection'))}"),
        (0, 9, "true", "'Top Category'", f"top_category || ' (' || {percent} || '%)'"),
        (1, 0, "true", "'Category'", "'Amount (' || trim(label) || ') Percentage'"),
        (2, 1, "true", "'Insight'",
         f"top_category || ' dominates your spending (' || {percent} || '% of total expenses).'"),
        (2, 2, "ratio >= 1.5", "'Insight'",
         f"'You spend ~' || printf('%.1f', {_settled('ratio')}) || 'x more on ' || top_category "
         "|| ' compared to your 2nd highest category.'"),
        (2, 3, "top_percent > 50", "'Insight'",
         "'Spending is highly concentrated -> low diversification.'"),
        (3, 1, "true", "'Highest Single Transaction'", f"label || {_plain('highest')}"),
        (3, 2, "true", "'Lowest Single Transaction'",
         f"label || CASE WHEN lowest > 0 THEN {_plain('lowest')} ELSE '0' END"),
        (3, 3, "habit IS NOT NULL", "'Frequent small expenses detected in'", "habit"),
        (3, 4, "anomalies > 0", "'Unusual'",
         "anomalies || ' unusually high transactions found.'"),
        (4, 1, "true", "'TIP'",
         "'Reduce ' || top_category || ' spending by 15% -> Save ' || label "
         f"|| printf('%.2f', {_settled('top_amount')} * 0.15) || '/month'"),
        (4, 2, "habit IS NOT NULL", "'TIP'",
         "'Track frequent small expenses like ''' || habit || ''' closely.'"),
        (4, 3, "anomalies > 0", "'ALERT'",
         "anomalies || ' unusually high transactions -- review immediately.'"),
        (5, 1, "true", "'Category Balance'",
         "CASE WHEN top_percent > 50 THEN 80 ELSE 100 END || ' / 100'"),
        (5, 2, "true", "'Spending Control'",
         f"CASE WHEN {_two('burn')} > 100 THEN 85 ELSE 100 END || ' / 100'"),
        (5, 3, "true", "'Risk Level'",
         "CASE WHEN anomalies > 2 THEN 'High' WHEN anomalies > 0 THEN 'Moderate' ELSE 'Low' END"),
    ]
    union = " UNION ALL ".join(
        f"SELECT k, {section} AS section, {order} AS o, {label} AS label, {value} AS value "
        f"FROM labelled WHERE {condition}"
        for section, order, condition, label, value in lines
    )
    part = "CASE WHEN total > 0 THEN amt / total * 100 ELSE 0 END"
    return _metrics(keys) + f""",
labelled AS (SELECT *, {_LABEL} AS label FROM metrics),
lines AS ({union} UNION ALL SELECT k, 1, place, cat,
  printf('%.2f', {_settled('amt')}) || ' (' || printf('%.1f', {_settled(part)}) || '%)'
  FROM cats JOIN base USING (k))
SELECT {shown}section, row_number() OVER (PARTITION BY k, section ORDER BY o) AS line, label, value
FROM lines"""


def _ledger(select: str) -> str:
    return LEDGER + select


def _own(sql: str) -> str:
    return sql.replace(_CATEGORY, _category(OWN_TAXONOMY))


_USER = "k AS user_id, "

_KIND = "CASE " + " ".join(
    f"WHEN ext IN ({_list(suffixes)}) THEN {_text(kind)}" for kind, suffixes in FILE_KINDS.items()
) + f" ELSE {_text(OTHER_FILES)} END"

_EXT = r"regexp_extract({0}, '^\.*[^.].*?(\.[^.]*)$', 1)"

INVENTORY = f"""
WITH inv AS ({INVENTORY_SQL.format(S="varchar")}),
named AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, regexp_replace(path, '/[^/]*$', '') AS folder
  FROM inv),
typed AS (SELECT *, lower({_EXT.format('name')}) AS ext FROM named),
files AS (SELECT *, {_KIND} AS category FROM typed)
"""


def _name_plan(source: str) -> str:
    """CTEs from ``source(path, f, n)`` and ``held(f, n)`` to ``planned(path, f, n, new_name)``."""
    ext = _EXT.format("n")
    stem = f"left(n, length(n) - length({ext}))"
    numbered = r"'^(.*)_([1-9][0-9]{0,17})$'"
    return source + f""",
placed AS (SELECT path, s.f, s.n, (h.n IS NOT NULL)::int - 1
    + row_number() OVER (PARTITION BY s.f, s.n ORDER BY substr(md5(path), 1, 3), path) AS place
  FROM source s LEFT JOIN held h ON s.f = h.f AND s.n = h.n),
names AS (SELECT f, n, {ext} AS e, {stem} AS b FROM source UNION SELECT f, n, {ext}, {stem} FROM held),
taken AS (SELECT DISTINCT f, regexp_extract(b, {numbered}, 1) || e AS n,
    cast(regexp_extract(b, {numbered}, 2) AS bigint) AS t, e
  FROM names WHERE regexp_matches(b, {numbered})),
starts AS (SELECT f, n, t + 1 - row_number() OVER (PARTITION BY f, n ORDER BY t) AS start
  FROM taken WHERE {ext} = e),
passed AS (SELECT p.path, count(*) AS skipped FROM placed p
  JOIN starts s ON p.f = s.f AND p.n = s.n AND s.start <= p.place GROUP BY p.path),
planned AS (SELECT path, f, n, CASE WHEN place = 0 THEN n
    ELSE {stem} || '_' || (place + coalesce(skipped, 0)) || {ext} END AS new_name
  FROM placed LEFT JOIN passed USING (path))
"""


_HUMAN = """CASE WHEN length < 1024 THEN printf('%.1f', length::double) || ' B'
  WHEN length < 1048576 THEN printf('%.1f', length / 1024.0::double) || ' KB'
  WHEN length < 1073741824 THEN printf('%.1f', length / 1048576.0::double) || ' MB'
  WHEN length < 1099511627776 THEN printf('%.1f', length / 1073741824.0::double) || ' GB'
  ELSE printf('%.1f', length / 1099511627776.0::double) || ' TB' END"""
_SHORT = """CASE WHEN length > 1048576
  THEN printf('%.2f', floor(length / 1048576.0::double * 100 + 0.5) / 100) || ' MB'
  ELSE printf('%.1f', floor(length / 1024.0::double * 10 + 0.5) / 10) || ' KB' END"""

MARKDOWN = """
WITH parts AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
marked AS (SELECT doc_id, i, CASE (doc_id + i) % 6 WHEN 0 THEN '# ' WHEN 1 THEN '## '
    WHEN 2 THEN '### ' WHEN 3 THEN '- ' WHEN 4 THEN '* ' ELSE '' END || line
    || CASE WHEN doc_id % 3 = 0 THEN '€' ELSE '' END
    || CASE WHEN i = 0 THEN chr(10) ELSE '' END AS line FROM parts),
md AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM marked GROUP BY doc_id),
md_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM md)
"""

_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"

_SPLIT = """
WITH placed AS (SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id) AS total,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM conversations),
cut AS (SELECT *, {0} AS split_at FROM placed)
SELECT conv_id, turn, role, CASE WHEN seq < split_at THEN 1 ELSE 2 END AS part,
  CASE WHEN seq < split_at THEN seq ELSE seq - split_at + 1 END AS part_pos, split_at, total FROM cut
"""

_STATS = f"""{_four('sum("Amt")')} AS total, {_four('avg("Amt")')} AS mean,
  {_four('stddev_samp("Amt")')} AS std, count(*) AS count, max("Amt") AS highest,
  coalesce(min("Amt") FILTER (WHERE "Amt" > 0), 0) AS lowest"""

ORACLES: dict[str, str] = {
    "normalize_ledger": _ledger('SELECT event_id, "Date", "Desc", "Amt", "Category" FROM ledger'),
    "normalize_sparse_ledger": _ledger(
        'SELECT "Date", "Desc", "Amt", \'€\' AS currency FROM ledger WHERE event_id % 10 <> 0 '
        'AND NOT ("Date" IS NULL AND raw_desc IS NULL AND raw_amt IS NULL)'
    ),
    "categorize_totals": _ledger(
        f'SELECT "Category", {_four("""sum("Amt")""")} AS amount FROM ledger GROUP BY "Category"'
    ),
    "category_share_by_user": _ledger(f""",
sums AS (SELECT user_id, "Category", sum("Amt") AS amount FROM ledger GROUP BY ALL),
whole AS (SELECT user_id, sum(amount) AS total FROM sums GROUP BY user_id)
SELECT user_id, "Category", {_four('amount')} AS amount,
  {_four('CASE WHEN total > 0 THEN amount / total * 100 ELSE 0 END')} AS percent
FROM sums JOIN whole USING (user_id)"""),
    "top_category_by_user": _metrics("user_id") + f"""
SELECT {_USER}top_category, {_four('top_amount')} AS top_amount, {_four('top_percent')} AS top_percent,
  {_four('ratio')} AS ratio, top_percent > 50 AS concentrated FROM metrics""",
    "prediction_own_taxonomy_by_user": _own(_prediction("user_id", _USER)),
    "report_own_taxonomy": _own(_report("1", "")),
    "recurring_charges": _ledger(
        'SELECT "Desc", "Amt", count(*) AS count FROM ledger GROUP BY ALL HAVING count(*) >= 2'
    ),
    "recurring_charges_by_user": _ledger(
        'SELECT user_id, "Desc", "Amt", count(*) AS count FROM ledger GROUP BY ALL HAVING count(*) >= 2'
    ),
    "habits": _ledger(
        f'SELECT "Desc", count(*) AS count, {_four("""avg("Amt")""")} AS mean FROM ledger '
        'GROUP BY "Desc" HAVING count(*) >= 3'
    ),
    "habits_by_user": _ledger(
        f'SELECT user_id, "Desc", count(*) AS count, {_four("""avg("Amt")""")} AS mean FROM ledger '
        'GROUP BY user_id, "Desc" HAVING count(*) >= 3'
    ),
    "anomalies": _ledger(
        'SELECT "Date", "Desc", "Amt", "Category" FROM ledger WHERE "Amt" > '
        '(SELECT avg("Amt") + 2.5 * stddev_samp("Amt") FROM ledger)'
    ),
    "anomalies_by_user": _metrics("user_id") + (
        'SELECT user_id, "Date", "Desc", "Amt", "Category" FROM rows_ JOIN base USING (k) '
        'WHERE "Amt" > mean + 2.5 * std'
    ),
    "ledger_stats": _ledger(f"SELECT {_STATS} FROM ledger"),
    "ledger_stats_by_user": _ledger(f"SELECT user_id, {_STATS} FROM ledger GROUP BY user_id"),
    "burn_rate_by_user": _metrics("user_id") + (
        f"SELECT {_USER}days, {_two('burn')} AS burn_rate, {_two('projection')} AS projected FROM metrics"
    ),
    "burn_rate_orders": f"""
WITH base AS (SELECT o_custkey, {_settled('sum(o_totalprice)')} AS total,
  date_sub('day', min(o_orderdate), max(o_orderdate)) AS span FROM orders GROUP BY o_custkey),
spans AS (SELECT *, CASE WHEN span > 0 THEN span ELSE 30 END AS days FROM base)
SELECT o_custkey, days, {_two('total / days')} AS burn_rate, {_two('total / days * 30')} AS projected
FROM spans""",
    "health_score_by_user": _metrics("user_id") + f"SELECT {_USER}anomalies, score FROM metrics",
    "affordability_by_user": _metrics("user_id") + f"""
SELECT {_USER}{_two('projection')} AS projected,
  CASE WHEN {PRICE} < projection * 0.5 THEN 'Affordable' ELSE 'Risky' END AS status FROM metrics""",
    "affordability_strict_by_user": _metrics("user_id") + f"""
SELECT {_USER}{_two('projection')} AS projected,
  CASE WHEN {PRICE} <= 0 THEN 'Invalid' WHEN {PRICE} > {_two('projection')} * 0.30 THEN 'Risky'
    ELSE 'Affordable' END AS status FROM metrics""",
    "prediction": _prediction("1", ""),
    "prediction_by_user": _prediction("user_id", _USER),
    "detect_currency": _ledger(f"SELECT user_id, {_SYMBOL} AS currency FROM ledger GROUP BY user_id"),
    "date_parse_mixed": _ledger("SELECT event_id, date_ts FROM ledger"),
    "daily_trend": _ledger(
        f'SELECT "Date", {_four("""sum("Amt")""")} AS amount FROM ledger '
        'WHERE "Date" IS NOT NULL GROUP BY "Date"'
    ),
    "daily_trend_by_user": _ledger(
        f'SELECT user_id, "Date", {_four("""sum("Amt")""")} AS amount FROM ledger '
        'WHERE "Date" IS NOT NULL GROUP BY user_id, "Date"'
    ),
    "top5_desc": _ledger(
        f'SELECT "Desc", {_four("""sum("Amt")""")} AS amount FROM ledger GROUP BY "Desc" '
        'ORDER BY sum("Amt") DESC, "Desc" LIMIT 5'
    ),
    "top5_desc_by_user": _ledger(f""",
sums AS (SELECT user_id, "Desc", sum("Amt") AS amount FROM ledger GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY amount DESC, "Desc") AS place
  FROM sums)
SELECT user_id, "Desc", {_four('amount')} AS amount, place FROM placed WHERE place <= 5"""),
    "summary_by_value": _ledger(f"""
SELECT raw_desc AS category, {_four("sum(coalesce(try_cast(regexp_replace(raw_amt, '[^0-9.]', '', 'g') AS double), 0))")} AS amount
FROM clean WHERE raw_desc IS NOT NULL GROUP BY raw_desc"""),
    "strict_share_amount": _ledger("""
SELECT event_id, "Desc",
  coalesce(cast(nullif(regexp_replace(raw_amt, '[^0-9.\\-]', '', 'g'), '') AS double), 0) AS "Amt"
FROM ledger"""),
    "report_lines": _report("1", ""),
    "report_lines_by_user": _report("user_id", _USER),
    "file_classify": INVENTORY + "SELECT path, name, ext, category FROM files",
    "file_category_counts": INVENTORY
    + "SELECT category, count(*) AS files FROM files GROUP BY category",
    "file_suffix_filter": INVENTORY
    + "SELECT path, name FROM files WHERE lower(name) LIKE '%.pdf' AND starts_with(name, 'doc_')",
    "file_name_plan": _name_plan(INVENTORY + """,
source AS (SELECT path, category AS f, name AS n FROM files),
held AS (SELECT '' AS f, '' AS n WHERE false)""") + """
SELECT path, f AS category, n AS name, new_name FROM planned""",
    "file_export_plan": _name_plan(f"""
WITH outs AS ({OUTPUT_SQL.format(S="varchar")}),
source AS (SELECT path, '' AS f, regexp_replace(name, '^converted_', '') AS n FROM outs WHERE length > 0),
held AS (SELECT '' AS f, 'scan_en_' || doc_id || '.txt' AS n FROM documents
  UNION SELECT '', 'scan_en.txt')""") + """
SELECT path, name, n AS clean_name, new_name FROM planned JOIN outs USING (path)""",
    "latest_file_per_folder": INVENTORY + """
SELECT folder, arg_max(path, modified) AS path, max(modified) AS modified FROM files GROUP BY folder""",
    "stale_files": INVENTORY + """
SELECT folder, path, modified, row_number() OVER (PARTITION BY folder ORDER BY modified DESC, path DESC) > 1
  AS stale FROM files""",
    "file_size_label": INVENTORY + f"SELECT path, {_HUMAN} AS size, {_SHORT} AS label FROM files",
    "text_profile": f"""
SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '{_BREAKS}'))
  + CASE WHEN text = '' OR regexp_matches(text, '({_BREAKS})$') THEN 0 ELSE 1 END AS lines
FROM documents""",
    "latin1_sanitize": MARKDOWN
    + r"SELECT doc_id, regexp_replace(text, '[^\x{00}-\x{FF}]', '?', 'g') AS text FROM md",
    "line_table": MARKDOWN + "SELECT doc_id, line_no, line FROM md_lines",
    "markdown_blocks": MARKDOWN + """,
stripped AS (SELECT doc_id, line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM md_lines)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS block_no,
  CASE WHEN regexp_matches(s, '^#{1,3} ') THEN 'heading'
    WHEN regexp_matches(s, '^[-*] ') THEN 'bullet' ELSE 'paragraph' END AS kind,
  CASE WHEN starts_with(s, '### ') THEN 3 WHEN starts_with(s, '## ') THEN 2
    WHEN starts_with(s, '# ') THEN 1 END AS level,
  regexp_replace(s, '^(#{1,3}|[-*]) ', '') AS text
FROM stripped WHERE s <> ''""",
    "transcript_join": """
SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id""",
    "page_count": "SELECT conv_id, count(*) AS items FROM conversations GROUP BY conv_id",
    "sequence_merge": """
WITH pairs AS (SELECT conv_id // 2 AS merge_id FROM conversations GROUP BY 1
  HAVING count(DISTINCT conv_id) = 2)
SELECT merge_id, row_number() OVER (PARTITION BY merge_id ORDER BY conv_id % 2 DESC, turn) AS new_pos,
  conv_id, turn, text
FROM conversations JOIN pairs ON conv_id // 2 = merge_id""",
    "sequence_split_default": _SPLIT.format("(total + 1) // 2"),
    "sequence_split_at": _SPLIT.format("least(4, total)"),
    "data_url": "SELECT page_id, 'data:text/html;base64,' || to_base64(encode(html)) AS url FROM pages",
}
ORACLES["top_category_own_taxonomy_by_user"] = _own(ORACLES["top_category_by_user"])
