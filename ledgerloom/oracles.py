"""DuckDB SQL for the queries of this package; amounts in cents, VAT in millionths."""

from __future__ import annotations


def _text(cents: str) -> str:
    """A figure of cents as decimal text."""
    return f"CASE WHEN {cents} < 0 THEN '-' ELSE '' END || (abs({cents}) // 100) || '.' || lpad((abs({cents}) % 100)::VARCHAR, 2, '0')"


def _vat(cents: str) -> str:
    """15/115 of an amount in millionths, half up."""
    return f"(sign({cents})::BIGINT * ((abs({cents}) * 60000 + 23) // 46))::BIGINT"


def _ledger(unknown: str) -> str:
    """The ledger over orders as o, a, b and ledger; unknown says which orders don't say their direction."""
    return f"""
o AS (SELECT o_custkey::VARCHAR AS account, o_orderkey AS seq, o_orderdate::DATE AS date, strftime(o_orderdate, '%Y-%m') AS month,
             substr(o_orderpriority, 3, 20) || ' purchase ' || (o_custkey % 7) AS description,
             round(o_totalprice * 100)::BIGINT AS c, {unknown} AS u, o_orderstatus = 'F' AS f FROM orders),
a AS (SELECT account, seq, date, month, description, CASE WHEN NOT u AND NOT f THEN c END AS debit,
             CASE WHEN NOT u AND f THEN c END AS credit, CASE WHEN u THEN c END AS unassigned FROM o),
b AS (SELECT *, CASE WHEN seq % 13 <> 0 THEN (sum(coalesce(credit, 0) - coalesce(debit, 0)) OVER (PARTITION BY account ORDER BY date, seq))::BIGINT
             + CASE WHEN seq % 101 = 0 THEN 100 ELSE 0 END END AS balance,
             coalesce(credit <> 0, false) AS is_in, lower(description) AS d FROM a),
k AS (SELECT account, seq, date, month, description, debit, credit, unassigned, balance,
             CASE WHEN unassigned IS NOT NULL OR balance IS NULL THEN 'REVIEW_REQUIRED' ELSE 'APPROVED' END AS status,
             CASE WHEN is_in AND (contains(d, 'urgent') OR contains(d, 'high')) THEN 'Sales'
                  WHEN NOT is_in AND (contains(d, 'purchase 1') OR contains(d, 'purchase 4')) THEN 'Rent'
                  WHEN NOT is_in AND contains(d, 'medium') THEN 'Bank charges'
                  WHEN contains(d, 'low purchase') THEN 'Own accounts'
                  WHEN contains(d, 'specified purchase 2') OR contains(d, 'purchase 5') THEN 'Drawings'
                  WHEN is_in THEN 'Other income (uncategorised)' ELSE 'Other expenses (uncategorised)' END AS category FROM b),
kinds(category, type, vat, priority) AS (VALUES ('Sales', 'income', 'Yes', 0), ('Rent', 'expense', 'Yes', 1), ('Bank charges', 'expense', 'Yes', 2),
             ('Own accounts', 'transfer', 'No', 3), ('Drawings', 'drawings', 'No', 4),
             ('Other income (uncategorised)', 'income', 'No', 5), ('Other expenses (uncategorised)', 'expense', 'No', 6)),
ledger AS (SELECT k.*, kinds.type, kinds.vat, coalesce(credit, 0) - coalesce(debit, 0) AS net,
             CASE WHEN kinds.type = 'income' THEN 1 ELSE -1 END * (coalesce(credit, 0) - coalesce(debit, 0)) AS signed FROM k JOIN kinds USING (category))
"""


LEDGER = _ledger("o_orderkey % 29 = 0")

MOVES = """coalesce(sum(credit), 0)::BIGINT AS money_in, coalesce(sum(debit), 0)::BIGINT AS money_out, sum(net)::BIGINT AS net,
count(*) AS transactions, count(*) FILTER (status = 'REVIEW_REQUIRED') AS to_review"""


def _of(kind: str, name: str, sign: str = "") -> str:
    return f"({sign}coalesce(sum(signed) FILTER (type = '{kind}'), 0))::BIGINT AS {name}"


#: Balances carried from month to month.
CARRIED = """
mb AS (SELECT account, month, arg_min(balance + coalesce(debit, 0) - coalesce(credit, 0), (date, seq)) FILTER (balance IS NOT NULL) AS fv,
              arg_max(balance, (date, seq)) FILTER (balance IS NOT NULL) AS closing FROM ledger GROUP BY account, month),
carried AS (SELECT account, month, closing,
              coalesce(last_value(closing IGNORE NULLS) OVER (PARTITION BY account ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                       first_value(fv IGNORE NULLS) OVER (PARTITION BY account ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS opening FROM mb)
"""


def _ends(keys: str) -> str:
    """Balances worked back, by keys, as ends."""
    return f"""
seen AS (SELECT *, count(balance) OVER (PARTITION BY {keys} ORDER BY date, seq) AS n FROM ledger),
ends AS (SELECT {keys}, (max(CASE WHEN n = 1 AND balance IS NOT NULL THEN balance - net END) + sum(CASE WHEN n = 0 THEN -net ELSE 0 END))::BIGINT AS opening,
                arg_max(balance, (date, seq)) FILTER (balance IS NOT NULL) AS closing FROM seen GROUP BY {keys})
"""


def _vat_months(keys: str) -> str:
    part = lambda kind, more="": f"coalesce(sum(signed) FILTER (type = '{kind}'{more}), 0)::BIGINT"
    yes = " AND vat = 'Yes'"
    return f"""
vs AS (SELECT {keys}, {part("income")} AS income, {part("expense")} AS expenses, {part("income", yes)} AS iv, {part("expense", yes)} AS ev
       FROM ledger WHERE type IN ('income', 'expense') GROUP BY {keys}),
vm AS (SELECT *, {_vat("iv")} AS vi, {_vat("ev")} AS ve FROM vs)
"""


MONTHLY_SUMMARY = f"""
WITH {LEDGER}, {CARRIED}, s AS (SELECT account, month, {MOVES} FROM ledger GROUP BY account, month)
SELECT account, month, opening, money_in, money_out, net, closing, opening + money_in - money_out - closing AS difference, transactions, to_review
FROM s JOIN carried USING (account, month)
"""

MONTHLY_TOTAL_ROLLUP = f"WITH {LEDGER} SELECT account, month, {MOVES} FROM ledger GROUP BY ROLLUP (account, month)"

MONTHLY_TABLE = f"""
WITH {LEDGER}, {_ends("account, month")}, {_vat_months("account, month")},
s AS (SELECT account, month, {MOVES}, {_of("income", "income")}, {_of("expense", "expenses")} FROM ledger GROUP BY account, month)
SELECT s.account, s.month, strftime((s.month || '-01')::DATE, '%b %Y') AS label, opening, closing, money_in, money_out, s.income, s.expenses,
       s.income - s.expenses AS profit, coalesce(vi - ve, 0)::BIGINT AS vat_payable, transactions, to_review
FROM s JOIN ends USING (account, month) LEFT JOIN vm ON vm.account = s.account AND vm.month = s.month
"""

_CHAIN = """
x AS (SELECT *, lag(balance) OVER w + net AS expected, lag(date) OVER w AS after_date FROM ledger WINDOW w AS (PARTITION BY account ORDER BY date, seq))
"""
BALANCE_BREAKS = f"WITH {LEDGER}, {_CHAIN} SELECT account, seq, expected, balance, balance - expected AS missing FROM x WHERE balance <> expected"
WORKBOOK_GAPS = f"""
WITH {LEDGER}, {_CHAIN}
SELECT account, after_date::VARCHAR AS after_date, date::VARCHAR AS at_date, seq, description, expected, balance AS actual, balance - expected AS missing
FROM x WHERE balance <> expected
"""
OPENING_CLOSING = f"WITH {LEDGER}, {_ends('account')} SELECT account, opening, closing FROM ends"

FLAG_DUPLICATES = """
WITH r AS (SELECT l_orderkey AS account, l_partkey, l_suppkey, l_extendedprice, l_linenumber, l_returnflag, year(l_shipdate) AS y, l_quantity::BIGINT % 5 AS u,
                  CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS e, CASE WHEN l_partkey % 3 <> 0 THEN l_suppkey END AS bal FROM lineitem),
w AS (SELECT *, row_number() OVER p AS n, lag(e) OVER p AS pe, lag(bal) OVER p AS pb FROM r
      WINDOW p AS (PARTITION BY account, y, u ORDER BY l_partkey, l_suppkey, l_extendedprice, l_linenumber, l_returnflag))
SELECT account, count(*) AS n, sum(l_partkey)::BIGINT AS parts FROM w
WHERE n > 1 AND CASE WHEN e IS NOT NULL AND pe IS NOT NULL THEN e = pe ELSE bal IS NULL OR pb IS NULL OR bal = pb END
GROUP BY account
"""

FLAG_DATE_ORDER = """
WITH e AS (SELECT user_id AS account, ts::DATE AS date, event_id AS seq, event_id * 7919 % 1009 AS place FROM events),
p AS (SELECT *, lag(date) OVER (PARTITION BY account ORDER BY place, seq) AS before FROM e),
r AS (SELECT *, count(*) FILTER (before <= date) OVER (PARTITION BY account) >= count(*) FILTER (before >= date) OVER (PARTITION BY account) AS rising FROM p)
SELECT account, count(*) FILTER (CASE WHEN rising THEN date < before ELSE date > before END) AS n_out, count(*) AS n FROM r GROUP BY account
"""

CONFIRM_GROUPS = f"""
WITH {LEDGER},
s AS (SELECT account, date, seq, coalesce(debit, credit) AS amount, CASE WHEN seq % 3 = 0 THEN CASE WHEN credit IS NOT NULL THEN 1 ELSE -1 END END AS sign, balance
      FROM ledger WHERE unassigned IS NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY date, seq) AS pos,
             count(balance) OVER w AS group_id, last_value(balance IGNORE NULLS) OVER w AS before
      FROM s WINDOW w AS (PARTITION BY account ORDER BY date, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT *, row_number() OVER (PARTITION BY account, group_id, sign IS NULL ORDER BY pos) - 1 AS bit FROM r),
g AS (SELECT account, group_id, max(balance) - max(before) - coalesce(sum(amount * sign), 0) AS need, count(*) FILTER (sign IS NULL) AS unknown FROM n GROUP BY account, group_id),
m AS (SELECT account, group_id, need, unnest(range(0, 1 << unknown::INT)) AS mask FROM g WHERE unknown <= 10),
t AS (SELECT m.account, m.group_id, mask, need, coalesce(sum(CASE WHEN (mask >> bit::INT) & 1 = 1 THEN amount ELSE -amount END), 0) AS total
      FROM m LEFT JOIN n ON n.account = m.account AND n.group_id = m.group_id AND n.sign IS NULL GROUP BY m.account, m.group_id, mask, need),
f AS (SELECT account, group_id, count(*) FILTER (total = need) AS fits, max(mask) FILTER (total = need) AS way FROM t GROUP BY account, group_id)
SELECT n.account, n.seq, n.group_id, coalesce(fits, 0) AS fits,
       coalesce(n.sign, CASE WHEN fits = 1 THEN CASE WHEN (way >> bit::INT) & 1 = 1 THEN 1 ELSE -1 END END)::BIGINT AS resolved_sign
FROM n LEFT JOIN f USING (account, group_id)
"""

PAGE_SEGMENTS = r"""
WITH p AS (SELECT page_id // 50 AS file, page_id, CASE WHEN page_id % 3 = 0 THEN regexp_extract(url, 'example\.([a-z]+)', 1) END AS period FROM pages),
q AS (SELECT *, last_value(period IGNORE NULLS) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p)
SELECT file, page_id, (sum(CASE WHEN period <> before THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY page_id))::BIGINT AS segment FROM q
"""

MISSING_PAGES = """
WITH p AS (SELECT page_id // 8 AS file, page_id % 8 + 1 AS n FROM pages WHERE page_id % 4 <> 2),
f AS (SELECT file, unnest(range(1, 9)) AS n FROM (SELECT DISTINCT file FROM p))
SELECT f.file, coalesce(string_agg(CASE WHEN p.n IS NULL THEN f.n::VARCHAR END, ',' ORDER BY f.n), '') AS missing
FROM f LEFT JOIN p ON p.file = f.file AND p.n = f.n GROUP BY f.file
"""

INCOME_STATEMENT_PIVOT = f"""
WITH {LEDGER}
SELECT 'all' AS account, type, category, coalesce(sum(signed) FILTER (month = '1995-01'), 0)::BIGINT AS m199501,
       coalesce(sum(signed) FILTER (month = '1995-02'), 0)::BIGINT AS m199502, coalesce(sum(signed) FILTER (month = '1995-03'), 0)::BIGINT AS m199503, sum(signed)::BIGINT AS total
FROM ledger WHERE month IN ('1995-01', '1995-02', '1995-03') GROUP BY GROUPING SETS ((type, category), (type))
"""

_FLOW = f"""
fl AS (SELECT account, month, {_of("income", "income")}, {_of("expense", "expenses", "-")}, {_of("transfer", "transfers", "-")}, {_of("drawings", "drawings", "-")} FROM ledger GROUP BY account, month),
flow AS (SELECT *, income + expenses AS operations, income + expenses + transfers + drawings AS change FROM fl JOIN carried USING (account, month))
"""
CASH_FLOW = f"""
WITH {LEDGER}, {CARRIED}, {_FLOW}
SELECT account, month, opening, income, expenses, operations, transfers, drawings, change, opening + change AS closing_calculated, closing AS closing_printed,
       opening + change - closing AS difference FROM flow
"""
CASH_FLOW_TOTAL = f"""
WITH {LEDGER}, {CARRIED}, {_FLOW},
t AS (SELECT account, first(opening ORDER BY month) AS opening, sum(income)::BIGINT AS income, sum(expenses)::BIGINT AS expenses, sum(transfers)::BIGINT AS transfers,
             sum(drawings)::BIGINT AS drawings, sum(change)::BIGINT AS change, last(closing ORDER BY month) AS closing_printed FROM flow GROUP BY account)
SELECT *, opening + change AS closing_calculated FROM t
"""
CATEGORY_BREAKDOWN = f"""
WITH {LEDGER}
SELECT account, type, category, count(*) AS transactions, coalesce(sum(credit), 0)::BIGINT AS money_in, coalesce(sum(debit), 0)::BIGINT AS money_out, sum(net)::BIGINT AS net
FROM ledger GROUP BY account, type, category
"""
SPEND_BY_CATEGORY = f"WITH {LEDGER} SELECT 'all' AS account, category, sum(signed)::BIGINT AS spent FROM ledger WHERE type = 'expense' GROUP BY category"
VAT_BY_MONTH = f"""
WITH {LEDGER}, {_vat_months("month")}
SELECT month, income, expenses, iv AS income_with_vat, vi AS vat_on_income, ve AS vat_on_expenses, vi - ve AS vat_payable FROM vm
"""
VAT_RETURN = f"""
WITH {LEDGER}, {_vat_months("month")}
SELECT month, unnest(['1', '2 / 3', '4', '13', '15', '19', '20']) AS field,
       unnest([iv * 10000, (income - iv) * 10000, vi, vi, ve, ve, vi - ve]) AS amount FROM vm
"""
VAT_RETURN_BY_PERIOD = f"""
WITH {LEDGER}, {_vat_months("month")}, d AS (SELECT *, (month || '-01')::DATE AS d FROM vm),
e AS (SELECT *, CASE WHEN month(d) % 2 = 1 THEN d ELSE d + INTERVAL 1 MONTH END AS e FROM d),
p AS (SELECT e, sum(income)::BIGINT AS income, sum(iv)::BIGINT AS iv, sum(ev)::BIGINT AS ev FROM e GROUP BY e),
-- 3/23 of an amount, half up; no amount lies between.
c AS (SELECT *, (sign(iv)::BIGINT * ((abs(iv) * 6 + 23) // 46))::BIGINT AS vi, (sign(ev)::BIGINT * ((abs(ev) * 6 + 23) // 46))::BIGINT AS ve, (sign(iv - ev)::BIGINT * ((abs(iv - ev) * 6 + 23) // 46))::BIGINT AS pay FROM p)
SELECT strftime(e - INTERVAL 1 MONTH, '%b %Y') || ' - ' || strftime(e, '%b %Y') AS label, strftime(e, '%Y-%m') AS end_month,
       unnest(['1', '2 / 3', '4', '13', '15', '19', '20']) AS field, unnest([iv, income - iv, vi, vi, ve, ve, pay]) AS amount FROM c
"""
RANGE_OF_MONTHS = f"""
WITH {LEDGER} SELECT account, month, {MOVES} FROM ledger WHERE month BETWEEN '1994-03' AND '1996-08' GROUP BY ROLLUP (account, month)
"""
VAT_REGISTRATION = f"""
WITH {LEDGER} SELECT category, CASE WHEN type IN ('income', 'expense') AND category NOT LIKE '%(uncategorised)' THEN 'Yes' ELSE 'No' END AS registered, 'No' AS other, count(*) AS n FROM ledger GROUP BY ALL
"""
NEWEST_FILES = "SELECT o_orderkey AS name, o_orderdate::DATE::VARCHAR AS modified FROM orders ORDER BY o_orderdate::DATE DESC, o_orderkey LIMIT 30"
VAT_SUMMARY = f"""
WITH {LEDGER}, {_vat_months("month")}
SELECT month, income - expenses AS difference, income * 10000 - vi AS income_excl, expenses * 10000 - ve AS expenses_excl,
       (income - expenses) * 10000 - vi + ve AS difference_excl FROM vm
"""
VAT_NET_LINEITEM = """
WITH c AS (SELECT l_returnflag, l_linestatus, round(l_extendedprice * 100)::BIGINT AS c FROM lineitem)
SELECT l_returnflag, l_linestatus, sum(c)::BIGINT AS gross, sum((c * 200 + 115) // 230)::BIGINT AS net FROM c GROUP BY l_returnflag, l_linestatus
"""
MONTH_VAT_SHEET = f"""
WITH {LEDGER},
r AS (SELECT *, row_number() OVER (PARTITION BY account, month, type ORDER BY date, seq) AS n FROM ledger WHERE type IN ('income', 'expense')),
v AS (SELECT *, CASE WHEN vat = 'Yes' THEN {_vat("signed")} ELSE 0 END AS va FROM r)
SELECT account, seq, upper(strftime(date, '%b%y')) || CASE WHEN type = 'income' THEN 'R' ELSE 'P' END || CASE WHEN n < 100 THEN lpad(n::VARCHAR, 2, '0') ELSE n::VARCHAR END AS reference,
       vat, signed AS amount, va AS vat_amount, signed * 10000 - va AS amount_excl FROM v
"""

_MONTHS = """
mm AS (SELECT DISTINCT month, (month || '-01')::DATE AS d FROM ledger),
fy AS (SELECT month, d, year(d) - CASE WHEN month(d) < 3 THEN 1 ELSE 0 END AS y, ((month(d) + 9) % 12) // 3 + 1 AS q FROM mm)
"""
_FY = "'FY' || y || '/' || lpad(((y + 1) % 100)::VARCHAR, 2, '0')"
PERIOD_SUMMARY = f"""
WITH {LEDGER}, {CARRIED}, {_MONTHS},
bridge AS (
  SELECT 'all' AS kind, 'All months (' || (SELECT strftime(min(d), '%b %Y') || ' - ' || strftime(max(d), '%b %Y') FROM mm) || ')' AS label, '0' AS sort_key, 0 AS length, month FROM fy
  UNION ALL SELECT 'year', {_FY} || ' (Mar ' || y || ' - Feb ' || (y + 1) || ')', '1-' || y || '-0', 12, month FROM fy
  UNION ALL SELECT 'quarter', {_FY} || ' Q' || q || ' (' || strftime(make_date(y, 3, 1) + to_months((3 * (q - 1))::INT), '%b') || ' - '
                   || strftime(make_date(y, 3, 1) + to_months((3 * q - 1)::INT), '%b %Y') || ')', '1-' || y || '-' || q, 3, month FROM fy
  UNION ALL SELECT 'month', strftime(d, '%b %Y'), '2-' || month, 1, month FROM fy),
s AS (SELECT account, month, {MOVES}, {_of("income", "income")}, {_of("expense", "expenses")} FROM ledger GROUP BY account, month),
p AS (SELECT account, kind, label, sort_key, length, count(*) AS months, first(opening ORDER BY month) AS opening, arg_max(closing, month) FILTER (closing IS NOT NULL) AS closing,
             sum(money_in)::BIGINT AS money_in, sum(money_out)::BIGINT AS money_out, sum(income)::BIGINT AS income, sum(expenses)::BIGINT AS expenses,
             sum(transactions)::BIGINT AS transactions, sum(to_review)::BIGINT AS to_review
      FROM s JOIN carried USING (account, month) JOIN bridge USING (month) GROUP BY account, kind, label, sort_key, length)
SELECT account, kind, label, sort_key, months, months < length AS partial, opening, closing, money_in, money_out, income, expenses, income - expenses AS net_profit, transactions, to_review FROM p
"""
VAT_PERIODS_AB = f"""
WITH {LEDGER}, mm AS (SELECT DISTINCT month, (month || '-01')::DATE AS d FROM ledger),
e AS (SELECT 'A' AS category, month, CASE WHEN month(d) % 2 = 1 THEN d ELSE d + INTERVAL 1 MONTH END AS e FROM mm
      UNION ALL SELECT 'B', month, CASE WHEN month(d) % 2 = 0 THEN d ELSE d + INTERVAL 1 MONTH END FROM mm UNION ALL SELECT 'C', month, d FROM mm)
SELECT CASE WHEN category = 'C' THEN '' ELSE strftime(e - INTERVAL 1 MONTH, '%b %Y') || ' - ' END || strftime(e, '%b %Y') AS label,
       strftime(e, '%Y-%m') AS end_month, month, category FROM e
"""
OVERVIEW = f"""
WITH {LEDGER}, {_ends("account")},
s AS (SELECT account, {MOVES}, {_of("income", "income")}, {_of("expense", "expenses")}, {_of("transfer", "transfers")}, {_of("drawings", "drawings")} FROM ledger GROUP BY account)
SELECT account, opening, closing, money_in, money_out, income, expenses, transfers, drawings, transactions, to_review FROM s JOIN ends USING (account)
"""
MONEY_CHART = f"""
WITH {LEDGER}
SELECT month, 'money_in' AS flow, coalesce(sum(credit), 0)::BIGINT AS amount FROM ledger GROUP BY month
UNION ALL SELECT month, 'money_out', coalesce(sum(debit), 0)::BIGINT FROM ledger GROUP BY month
"""

CATEGORIZE_FIRST_MATCH = """
WITH p AS (SELECT p_partkey, p_size, lower(coalesce(p_name, '')) || chr(10) || lower(coalesce(p_type, '')) AS t FROM part)
SELECT p_partkey, CASE WHEN contains(t, 'steel') OR contains(t, 'brass') OR contains(t, 'copper') THEN 'Metals'
                       WHEN p_size > 20 AND (contains(t, 'green') OR contains(t, 'lime')) THEN 'Green'
                       WHEN contains(t, 'small') THEN 'Small' ELSE 'Other' END AS category FROM p
"""
REPORT_CATEGORIES = f"""
WITH {LEDGER},
u AS (SELECT CASE WHEN seq % 17 = 0 THEN 'Manual' ELSE category END AS category, net FROM ledger),
n AS (SELECT category, sum(net) AS net FROM u GROUP BY category),
t AS (SELECT category, coalesce(kinds.type, CASE WHEN net > 0 THEN 'income' ELSE 'expense' END) AS type, coalesce(priority, 1000000) AS priority FROM n LEFT JOIN kinds USING (category))
SELECT category, type, row_number() OVER (ORDER BY list_position(['income', 'expense', 'transfer', 'drawings'], type), priority, category) AS place FROM t
"""


def _keyed(name: str, where: str) -> str:
    base = f"""'c|b|' || account || '|' || date::VARCHAR || '|' || array_to_string(list_sort(string_split(lower(description), ' ')), ' ') || '|'
       || coalesce({_text("debit")}, '') || '|' || coalesce({_text("credit")}, '') || '|' || coalesce({_text("balance")}, '') || coalesce('|u' || {_text("unassigned")}, '')"""
    return f"""
{name}_b AS (SELECT seq, {base} AS base FROM ledger WHERE {where}),
{name}_n AS (SELECT seq, base, row_number() OVER (PARTITION BY base ORDER BY seq) - 1 AS n FROM {name}_b),
{name}_k AS (SELECT seq, substr(sha256(base || CASE WHEN n > 0 THEN '|' || n ELSE '' END), 1, 24) AS row_key FROM {name}_n)
"""


ROW_KEY_DEDUP = f"""
WITH {LEDGER}, {_keyed("old", "seq % 3 <> 0")}, {_keyed("new", "seq % 3 <> 1")}
SELECT seq, row_key FROM old_k UNION ALL SELECT seq, row_key FROM new_k WHERE row_key NOT IN (SELECT row_key FROM old_k)
"""
FILE_REGISTRY = """
SELECT c_name AS source_id, sha256(c_mktsegment) AS content_hash, c_custkey AS processed_at FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0
"""
MIXED_ACCOUNTS = f"""
WITH {LEDGER},
r AS (SELECT CASE WHEN seq % 2 = 0 THEN account ELSE '' END AS a2, account, 'f' || month AS source_file, seq FROM ledger),
h AS (SELECT DISTINCT a2 AS account, source_file FROM r WHERE account::BIGINT % 5 = 0),
n AS (SELECT DISTINCT a2 AS account, source_file FROM r WHERE account::BIGINT % 5 <> 0)
SELECT account, source_file FROM n WHERE CASE WHEN account = '' THEN source_file NOT IN (SELECT source_file FROM h) ELSE account NOT IN (SELECT account FROM h) END
"""

PARSE_AMOUNT_FORMATS = """
WITH o AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS c FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (0, 3, 4) THEN c WHEN o_orderkey % 8 IN (1, 2, 5) THEN -c END AS amount FROM o
"""
PARSE_DATE_FORMATS = "SELECT o_orderkey, CASE WHEN o_orderkey % 9 < 7 THEN o_orderdate::DATE::VARCHAR END AS day FROM orders"
FISCAL_CALENDAR = f"""
WITH mm AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders),
fy AS (SELECT d, year(d) - CASE WHEN month(d) < 3 THEN 1 ELSE 0 END AS y, ((month(d) + 9) % 12) // 3 + 1 AS q FROM mm)
SELECT d::VARCHAR AS day, y AS fy, q AS quarter, {_FY} AS fy_label, strftime(d, '%b %Y') AS label FROM fy
"""
SAME_WORDS = r"SELECT p_partkey, array_to_string(list_sort(regexp_extract_all(lower(concat_ws(' | ', p_type, p_name)), '[^\s|]+')), ' ') AS words FROM part"
TELLING_WORDS = """
WITH w AS (SELECT o_orderkey, regexp_extract_all(lower(o_orderpriority), '[a-z][a-z]+') AS w FROM orders)
SELECT o_orderkey, array_to_string(list_concat(w, ['o''neil', 'co']), ' ') AS words FROM w
"""
GARBLED_FIGURES = """
WITH f AS (SELECT o_orderkey, translate(o_orderkey::VARCHAR || '.00', '015', 'OIS') AS f FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND regexp_matches(f, '[0-9]') THEN f ELSE '' END AS garbled FROM f
"""
RAND_FORMAT = """
WITH o AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS c FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 2 <> 0 AND c <> 0 THEN '-' ELSE '' END || 'R ' || replace(format('{:,}', c // 100), ',', ' ') || '.' || lpad((c % 100)::VARCHAR, 2, '0') AS shown FROM o
"""

LEARNED_CATEGORY = """
WITH p AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_type || ' ' || translate(p_brand, '#0123456789', '_abcdefghij')) AS description, p_size > 25 AS money_in, 'C' || (p_size % 3) AS category FROM part),
x AS (SELECT id, money_in, category, list_filter(regexp_extract_all(description, '[a-z][a-z&'']+'),
             lambda w: NOT list_contains(['jan','feb','mar','apr','may','jun','jul','aug','sep','sept','oct','nov','dec','january','february','march','april','june','july','august','september','october','november','december'], w)) AS w FROM p),
size AS (SELECT count(*) AS size FROM x WHERE id % 5 <> 1 AND len(w) > 0),
df AS (SELECT word, count(DISTINCT id) AS df FROM (SELECT id, unnest(w) AS word FROM x WHERE id % 5 <> 1) GROUP BY word),
n AS (SELECT id, word, count(*) AS n FROM (SELECT id, unnest(w) AS word FROM x) GROUP BY id, word),
t AS (SELECT id, word, coalesce(df, 0) AS df, size, n * (ln((1 + size) / (1 + coalesce(df, 0))) + 1) AS t FROM n LEFT JOIN df USING (word), size),
v AS (SELECT id, word, df, size, t / sqrt(sum(t * t) OVER (PARTITION BY id)) AS v, min(df) OVER (PARTITION BY id) AS rarest FROM t),
pairs AS (SELECT DISTINCT q.id AS q, e.id AS e FROM v q JOIN v e USING (word) WHERE q.id % 5 <> 0 AND e.id % 5 = 0 AND q.df = q.rarest AND q.df > 0 AND q.df <= q.size / 2),
ways AS (SELECT q, e, xe.category FROM pairs JOIN x xq ON xq.id = q JOIN x xe ON xe.id = e WHERE xq.money_in = xe.money_in),
near AS (SELECT q, e, category, sum(a.v * b.v) AS s FROM ways JOIN v a ON a.id = q JOIN v b ON b.id = e AND b.word = a.word GROUP BY q, e, category HAVING sum(a.v * b.v) >= 0.4),
top AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, e) AS k FROM near QUALIFY k <= 7),
best AS (SELECT q, category, sum(s) AS w, count(*) AS n_alike, arg_min(e, k) AS e, arg_min(s, k) AS s FROM top GROUP BY q, category),
r AS (SELECT *, sum(w) OVER (PARTITION BY q) AS every, row_number() OVER (PARTITION BY q ORDER BY round(w, 9) DESC, category) AS r FROM best)
SELECT q AS id, category, n_alike, e AS example_id, round(s * 1000000)::BIGINT AS similarity FROM r WHERE r = 1 AND w >= 0.75 * every
"""

CATEGORY_LIFECYCLE = f"""
WITH {LEDGER},
t AS (SELECT seq, category AS by_rule, CASE WHEN seq % 4 = 0 THEN 'Rent' WHEN seq % 4 = 1 THEN 'Drawings' WHEN seq % 4 = 3 THEN category END AS typed,
             CASE WHEN seq % 4 = 0 THEN 'Rent' END AS suggested, CASE WHEN seq % 5 = 0 THEN 'Yes' END AS vat FROM ledger),
u AS (SELECT *, coalesce(typed = suggested, false) OR coalesce(typed, '') IN ('', 'Other income (uncategorised)', 'Other expenses (uncategorised)') AS open FROM t),
c AS (SELECT *, CASE WHEN open THEN by_rule ELSE typed END AS category,
             CASE WHEN open THEN CASE WHEN by_rule NOT LIKE '%(uncategorised)' THEN 'Rule' END WHEN typed = by_rule THEN 'Rule' ELSE 'Set by you' END AS category_source FROM u)
SELECT seq, category, category_source, CASE WHEN c.category IS NOT DISTINCT FROM typed AND coalesce(c.vat, '') IN ('Yes', 'No') THEN c.vat ELSE coalesce(kinds.vat, 'No') END AS vat
FROM c LEFT JOIN kinds USING (category)
"""

#: Statements and checks as st (statement figures) and rw (rows); see operators.assess.
_ASSESS = f"""
rr AS (SELECT *, seq % 31 = 0 AS garbled, seq % 2 = 0 AS ocr, account::INT AS n FROM ledger),
s0 AS (SELECT account, max(n) AS n, coalesce(sum(credit), 0)::BIGINT AS tc, coalesce(sum(debit), 0)::BIGINT AS td, arg_max(balance, (date, seq)) FILTER (balance IS NOT NULL) AS lb,
              count(balance) AS n_balances, count(*) FILTER (coalesce(unassigned, 0) <> 0) AS n_unassigned FROM rr GROUP BY account),
s1 AS (SELECT *, CASE WHEN n % 3 <> 0 THEN 0 END AS opening, CASE WHEN n % 7 <> 0 THEN td + CASE WHEN n % 4 = 0 THEN 100 ELSE 0 END END AS pd, CASE WHEN n % 7 <> 0 THEN tc END AS pc,
              CASE WHEN n % 5 <> 0 THEN lb + CASE WHEN n % 6 = 0 THEN 200 ELSE 0 END END AS pb FROM s0),
s2 AS (SELECT *, coalesce(pd <> td, false) OR coalesce(pc <> tc, false) AS totals_wrong, pd IS NULL AND pc IS NULL AS no_totals, coalesce(pb <> lb, false) AS closing_wrong, opening + tc - td AS computed FROM s1),
st AS (SELECT *, n_balances = 0 AND (totals_wrong OR no_totals) AS no_running, totals_wrong OR closing_wrong AS unreconciled,
              array_to_string([x FOR x IN [
                CASE WHEN n_balances = 0 AND (totals_wrong OR no_totals) THEN 'no_running_balance' END, CASE WHEN totals_wrong THEN 'totals_differ' END,
                CASE WHEN pb IS NULL AND no_totals THEN 'end_not_proved' END, CASE WHEN closing_wrong THEN 'closing_differs' END,
                CASE WHEN n_unassigned = 0 AND computed <> lb THEN 'does_not_add_up' END, CASE WHEN n % 9 = 0 THEN 'no_account_number' END] IF x IS NOT NULL], ';') AS problems FROM s2),
w1 AS (SELECT rr.*, opening, unreconciled, no_running, n_balances, CASE WHEN row_number() OVER w = 1 THEN opening ELSE lag(balance) OVER w END + net AS expected,
              row_number() OVER same AS rep, lag(balance) OVER same AS same_balance
       FROM rr JOIN st USING (account)
       WINDOW w AS (PARTITION BY rr.account ORDER BY date, seq), same AS (PARTITION BY rr.account, date, description, debit, credit, unassigned ORDER BY date, seq)),
rw AS (SELECT *, array_to_string([x FOR x IN [
                CASE WHEN unassigned IS NOT NULL THEN 'direction_unknown' END, CASE WHEN no_running THEN 'not_confirmed' END,
                CASE WHEN n_balances > 0 AND balance IS NULL THEN 'no_balance' END, CASE WHEN balance <> expected THEN 'chain_break' END,
                CASE WHEN garbled THEN 'garbled_figure' END, CASE WHEN date NOT BETWEEN DATE '1992-06-01' AND DATE '1998-06-30' THEN 'outside_period' END,
                CASE WHEN unreconciled THEN 'statement_unreconciled' END] IF x IS NOT NULL], ';') AS reasons FROM w1)
"""
ASSESS_ROWS = f"""
WITH {LEDGER}, {_ASSESS}
SELECT account, seq, reasons, CASE WHEN reasons = '' THEN 'APPROVED' ELSE 'REVIEW_REQUIRED' END AS status,
       CASE WHEN reasons <> '' THEN 80 WHEN ocr THEN 97 ELSE 100 END::BIGINT AS confidence FROM rw
"""
ASSESS_STATEMENTS = f"""
WITH {LEDGER}, {_ASSESS}, f AS (SELECT account, count(*) FILTER (reasons <> '') AS n_flagged FROM rw GROUP BY account)
SELECT account, problems, computed::BIGINT AS computed_closing, lb AS last_balance, pb AS printed_closing_used, n_flagged,
       CASE WHEN problems = '' AND n_flagged = 0 THEN 'APPROVED' ELSE 'REVIEW_REQUIRED' END AS status FROM st JOIN f USING (account)
"""

REVIEW_LINES = f"""
WITH {LEDGER}, {_ASSESS}, f AS (SELECT account, count(*) FILTER (reasons <> '') AS n_flagged, count(*) AS n FROM rw GROUP BY account)
SELECT account, tc::BIGINT AS total_credits, td::BIGINT AS total_debits, computed::BIGINT AS computed_closing, lb AS last_balance, f.n AS rows, n_flagged AS rows_to_review,
       CASE WHEN problems = '' AND n_flagged = 0 THEN 'APPROVED' ELSE 'REVIEW_REQUIRED' END AS status, replace(problems, ';', '; ') AS issues FROM st JOIN f USING (account)
"""
CHOOSE_READING = """
WITH r AS (SELECT l_orderkey, l_linenumber AS reading, sum(l_partkey % 3)::BIGINT AS n_problems, sum(l_suppkey % 4)::BIGINT AS n_flagged, count(*) AS n_rows FROM lineitem GROUP BY ALL)
SELECT l_orderkey, reading::BIGINT AS reading, n_problems, n_flagged, n_rows FROM r
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n_problems, n_flagged, n_rows DESC, reading) = 1
"""
COMPARE_READINGS = f"""
WITH {LEDGER},
n AS (SELECT account, seq, date::VARCHAR AS day, debit, credit, unassigned, row_number() OVER (PARTITION BY account ORDER BY date, seq) AS n, count(*) OVER (PARTITION BY account) AS most FROM ledger),
p AS (SELECT *, (n + 1) // 2 % 4 = 0 AND (n + 1) // 2 * 2 <= most AS swapped, seq % 6 = 0 AS lost, seq % 7 = 0 AS other, CASE WHEN seq % 7 = 0 THEN 100 ELSE 0 END AS more FROM n),
q AS (SELECT *, CASE WHEN NOT swapped THEN n WHEN n % 2 = 1 THEN n + 1 ELSE n - 1 END AS place, lead(lost OR other) OVER (PARTITION BY account ORDER BY n) AS next_gone FROM p),
-- Of two rows the other way round, both there, the second one counts.
r AS (SELECT *, NOT lost AND NOT other AND NOT (swapped AND n % 2 = 1 AND NOT next_gone) AS agreed FROM q)
SELECT account, 2 * n AS place, day, debit, credit, unassigned, CASE WHEN agreed THEN 'both' ELSE 'first' END AS side FROM r
UNION ALL SELECT account, 2 * place, day, debit + more, credit + more, unassigned + more, 'second' FROM r WHERE NOT lost AND NOT agreed
UNION ALL SELECT account, 2 * place + 1, day, debit + more, credit + more, unassigned + more, 'second' FROM r WHERE NOT lost AND seq % 11 = 0 AND NOT swapped
"""
#: All orders as they are printed: the true way and running balance b, and printed as hard statements have it.
_PRINTED = _ledger("false") + """,
q AS (SELECT *, row_number() OVER w AS line_no, (sum(net) OVER w)::BIGINT AS b, seq % 101 = 0 AND count(*) FILTER (seq % 101 = 0) OVER w = 1 AS wrong
      FROM ledger WINDOW w AS (PARTITION BY account ORDER BY date, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pr AS (SELECT account, seq, line_no, date, month, description, debit, credit, category, vat, b, coalesce(credit, debit) AS a, wrong, seq % 13 = 0 AND NOT wrong AS lost,
              CASE WHEN wrong THEN b + 100 WHEN seq % 13 <> 0 THEN b END AS printed FROM q)
"""
READ_LINES = f"""
WITH {_PRINTED}, x AS (SELECT *, printed - lag(printed, 1, 0) OVER (PARTITION BY account ORDER BY line_no) AS step FROM pr WHERE NOT lost)
SELECT account, 2 * line_no AS seq, date::VARCHAR AS day, description, CASE WHEN step = -a THEN a END AS debit, CASE WHEN step = a THEN a END AS credit,
       CASE WHEN abs(step) <> a THEN a END AS unassigned, printed AS balance FROM x
"""
UNKNOWN_LAYOUTS = f"""
WITH {_PRINTED},
x AS (SELECT *, NOT lost AND NOT wrong AS good, coalesce(bool_or(NOT lost AND NOT wrong) OVER (PARTITION BY account ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS later,
             account::INT % 5 = 4 AND (credit IS NOT NULL OR count(credit) OVER (PARTITION BY account) > 0) AS marked FROM pr)
SELECT account, 2 * line_no AS seq, date::VARCHAR AS day, description, CASE WHEN good OR later OR marked THEN debit END AS debit, CASE WHEN good OR later OR marked THEN credit END AS credit,
       CASE WHEN NOT (good OR later OR marked) THEN a END AS unassigned, printed AS balance, good OR lost AND later AS confirmed FROM x
"""
YEARLESS_DATES = f"""
WITH {_PRINTED}, s AS (SELECT *, account || '-' || year(date) AS s FROM pr)
SELECT s, 2 * row_number() OVER w AS seq, date::VARCHAR AS day, debit, credit, NULL::BIGINT AS unassigned, (sum(coalesce(credit, 0) - coalesce(debit, 0)) OVER w)::BIGINT AS balance, true AS confirmed
FROM s WINDOW w AS (PARTITION BY s ORDER BY line_no)
"""
CLIENT_OF_FILES = """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'Acme' WHEN c_mktsegment = 'BUILDING' THEN 'Builders' WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'Homes'
                       WHEN contains(c_name, '9') THEN 'Nines' ELSE 'UNMAPPED_CLIENT' END AS client FROM customer
"""
STATEMENT_STYLES = f"""
WITH {_PRINTED}, s AS (SELECT account, account::INT % 5 AS k, max(greatest(a, abs(printed))) AS most,
  count(*) FILTER (day(date) > 12) AS days FROM pr GROUP BY account)
SELECT account, CASE WHEN k = 1 THEN ',' ELSE '.' END AS decimal, k = 2 AND most >= 100000 AS spaced,
       CASE k WHEN 1 THEN 'ymd' WHEN 2 THEN 'd_mon_y' WHEN 4 THEN 'mon_d_y' ELSE 'dmy' END AS kind, false AS month_first FROM s
"""
STATEMENT_LEDGER = f"""
WITH {_PRINTED}, s AS (SELECT account, sum(debit) AS d FROM pr GROUP BY account)
SELECT account AS statement_id, '62' || lpad(account, 9, '0') AS account, 2 * (line_no + 9) AS seq, date::VARCHAR AS day, month, description, debit, credit, NULL::BIGINT AS unassigned, b AS balance,
       category, vat, CASE WHEN account::INT % 5 = 0 THEN 'REVIEW_REQUIRED' ELSE 'APPROVED' END AS status, CASE WHEN account::INT % 5 = 0 THEN 'statement_unreconciled' ELSE '' END AS reasons
FROM pr
"""
SECOND_READING = f"""
WITH {_PRINTED},
x AS (SELECT *, CASE WHEN account::INT % 9 = 0 THEN 'no_second_reading' WHEN line_no % 17 = 0 THEN 'second_reading_differs' ELSE '' END AS reasons FROM pr)
SELECT account AS statement_id, 2 * (line_no + 9) AS seq, debit, credit, NULL::BIGINT AS unassigned, b AS balance,
       CASE WHEN reasons = '' THEN 'APPROVED' ELSE 'REVIEW_REQUIRED' END AS status, reasons FROM x
"""
LINE_FORMATS = f"""
WITH {_PRINTED},
f AS (SELECT * EXCLUDE (lost), account::INT % 8 AS k, CASE WHEN account::INT % 8 IN (2, 7) AND line_no % 11 = 0 THEN 500 ELSE 0 END AS fee FROM pr),
g AS (SELECT *, (b - sum(fee) OVER (PARTITION BY account ORDER BY line_no))::BIGINT AS bb, k = 0 AND line_no % 13 = 1 AND line_no > 1 AS lost,
             CASE WHEN k IN (1, 6) THEN strftime(date, '%d %b') ELSE strftime(date, '%d/%m/%Y') END AS date_text FROM f)
SELECT account, 4 * line_no AS seq, date_text, description || CASE WHEN k IN (1, 5, 7) THEN ' no' WHEN k = 0 AND line_no % 7 = 0 THEN ' ref X' || line_no ELSE '' END AS description,
       CASE WHEN NOT lost THEN debit END AS debit, CASE WHEN NOT lost THEN credit END AS credit, CASE WHEN lost THEN a END AS unassigned, CASE WHEN fee = 0 THEN bb END AS balance
FROM g WHERE NOT (k = 0 AND line_no % 13 = 0)
UNION ALL
SELECT account, 4 * line_no + 1, date_text, 'Fee: ' || description || CASE WHEN k = 7 THEN ' no' ELSE '' END, fee, NULL, NULL, bb FROM g WHERE fee > 0
"""
PRINTED_TOTALS = """
WITH o AS (SELECT o_custkey AS account, CASE WHEN o_orderkey % 7 < 2 THEN round(o_totalprice * 100)::BIGINT END AS c FROM orders),
g AS (SELECT account, count(c) AS n, max(c) AS most, sum(c)::BIGINT AS all_, CASE WHEN account % 2 = 0 THEN max(c) END AS read FROM o GROUP BY account)
SELECT account, CASE WHEN n <= 1 THEN most WHEN most = read THEN most ELSE all_ END AS total FROM g
"""
VAT_RETURN_TOTAL = f"""
WITH {LEDGER}, {_vat_months("month")}, x AS (SELECT unnest(['1', '2 / 3', '4', '13', '15', '19', '20']) AS field,
       unnest([iv * 10000, (income - iv) * 10000, vi, vi, ve, ve, vi - ve]) AS amount FROM vm)
SELECT field, sum(amount)::BIGINT AS amount FROM x GROUP BY field
"""
VAT_SUMMARY_TOTAL = f"""
WITH {LEDGER}, {_vat_months("month")}, t AS (SELECT sum(income)::BIGINT AS income, sum(expenses)::BIGINT AS expenses, sum(iv)::BIGINT AS iv, sum(ev)::BIGINT AS ev FROM vm),
x AS (SELECT *, {_vat("iv")} AS vi, {_vat("ev")} AS ve FROM t)
SELECT income, expenses, income - expenses AS difference, vi AS vat_on_income, ve AS vat_on_expenses, income * 10000 - vi AS income_excl, expenses * 10000 - ve AS expenses_excl,
       (income - expenses) * 10000 - vi + ve AS difference_excl FROM x
"""
CATEGORY_BREAKDOWN_MONTH = f"""
WITH {LEDGER}, m AS (SELECT * FROM ledger WHERE month = '1995-03'), t AS (SELECT account, sum(signed)::BIGINT AS t FROM m WHERE type = 'expense' GROUP BY account),
c AS (SELECT account, type, category, count(*) AS transactions, coalesce(sum(credit), 0)::BIGINT AS money_in, coalesce(sum(debit), 0)::BIGINT AS money_out, sum(net)::BIGINT AS net
      FROM m GROUP BY account, type, category)
SELECT c.*, CASE WHEN type = 'expense' AND t <> 0 THEN (-net * 20000 + t) // (2 * t) END AS share_bp FROM c LEFT JOIN t USING (account)
"""
ENTRY_LINES = """
WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN ts::DATE END AS d, event_id % 4 AS n FROM events WHERE event_id % 11 <> 0),
l AS (SELECT *, lag(d) OVER w AS before, lag(n) OVER w AS n_before FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, coalesce(d, CASE WHEN n >= 2 AND n_before <= 1 THEN before END)::VARCHAR AS entry_date FROM l
"""
LISTED_LINES = """
WITH e AS (SELECT user_id, event_id, event_id % 5 IN (1, 2) AS single, CASE WHEN event_id % 7 <> 3 AND event_id % 5 NOT IN (1, 2) THEN event_id % 5 = 0 END AS head FROM events),
l AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS under FROM e)
SELECT user_id, event_id FROM l WHERE single AND under
"""
RUN_STATS = """
SELECT (SELECT count(*) FROM customer) AS files, (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) AS skipped,
       (SELECT count(*) FROM customer WHERE c_custkey % 2 <> 0) AS processed, (SELECT count(*) FROM orders WHERE o_custkey % 2 = 1) AS rows_added
"""
SHEET_ROWS = f"""
WITH {LEDGER},
so AS (SELECT * FROM ledger WHERE unassigned IS NULL),
p AS (SELECT account, seq, row_number() OVER w AS row_no, date, description, seq % 97 = 0 AS bad, seq % 89 = 0 AS blot, coalesce(credit, debit) AS size,
             CASE WHEN seq % 4 = 0 THEN CASE WHEN credit IS NOT NULL THEN 1 ELSE -1 END END AS sign,
             CASE WHEN seq % 89 <> 0 AND seq % 3 <> 0 THEN (sum(net) OVER w)::BIGINT END AS bal,
             CASE WHEN account::INT % 6 <> 0 THEN 0 END AS opening
      FROM so WINDOW w AS (PARTITION BY account ORDER BY date, seq)),
g AS (SELECT *, sum(CASE WHEN bad OR blot THEN 1 ELSE 0 END) OVER (PARTITION BY account ORDER BY row_no) AS segment FROM p),
h AS (SELECT *, count(bal) OVER b AS grp, coalesce(last_value(bal IGNORE NULLS) OVER b, CASE WHEN segment = 0 THEN opening END) AS before
      FROM g WINDOW b AS (PARTITION BY account, segment ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT *, CASE WHEN bad THEN 0 ELSE size END AS amount, CASE WHEN bad THEN 1 ELSE sign END AS way,
             row_number() OVER (PARTITION BY account, segment, grp, (CASE WHEN bad THEN 1 ELSE sign END) IS NULL ORDER BY row_no) - 1 AS bit FROM h),
q AS (SELECT account, segment, grp, max(before) AS before, max(bal) AS until, max(bal) - max(before) - coalesce(sum(amount * way), 0) AS need, count(*) FILTER (way IS NULL) AS unknown FROM n GROUP BY account, segment, grp),
m AS (SELECT account, segment, grp, need, unnest(range(0, 1 << unknown::INT)) AS mask FROM q WHERE unknown <= 10),
t AS (SELECT m.account, m.segment, m.grp, mask, need, coalesce(sum(CASE WHEN (mask >> bit::INT) & 1 = 1 THEN amount ELSE -amount END), 0) AS total
      FROM m LEFT JOIN n ON n.account = m.account AND n.segment = m.segment AND n.grp = m.grp AND n.way IS NULL GROUP BY m.account, m.segment, m.grp, mask, need),
f AS (SELECT account, segment, grp, count(*) FILTER (total = need) AS fits, max(mask) FILTER (total = need) AS fit FROM t GROUP BY account, segment, grp),
c AS (SELECT n.*, CASE WHEN bad THEN 'amount_unreadable' WHEN blot THEN 'balance_unreadable' WHEN fits = 1 THEN '' WHEN q.before IS NULL THEN 'no_earlier_balance'
                       WHEN until IS NULL THEN 'no_later_balance' WHEN fits > 1 THEN 'ambiguous' ELSE 'does_not_follow' END AS "check", fit
      FROM n JOIN q USING (account, segment, grp) LEFT JOIN f USING (account, segment, grp)),
d AS (SELECT *, CASE WHEN bad THEN NULL ELSE size END AS shown,
             CASE WHEN "check" = '' THEN coalesce(way, CASE WHEN (fit >> bit::INT) & 1 = 1 THEN 1 ELSE -1 END) ELSE sign END AS dir FROM c)
SELECT account, row_no AS seq, date::VARCHAR AS day, description, CASE WHEN dir = -1 THEN shown END AS debit, CASE WHEN dir = 1 THEN shown END AS credit,
       CASE WHEN dir IS NULL THEN shown END AS unassigned, bal AS balance, "check" FROM d
"""
DELIMITED_CELLS = f"""
WITH {LEDGER}, n AS (SELECT account, seq, description, coalesce(debit, credit, unassigned) AS a, row_number() OVER (PARTITION BY account ORDER BY seq) AS row_no, [',', ';', chr(9), '|'][account::INT % 4 + 1] AS mark FROM ledger),
c AS (SELECT account, row_no, unnest([1, 2, 3, 4]) AS col_no,
      unnest([seq::VARCHAR, CASE WHEN seq % 3 = 0 THEN description || mark || ' "x"' || chr(10) || seq ELSE description END, {_text("a")}, '']) AS value FROM n)
SELECT account AS path, row_no, col_no::BIGINT AS col_no, value FROM c
"""
RULE_TABLE = """
WITH r AS (SELECT p_partkey * 7919 % 100003 AS rule_order, p_brand AS rule, lower(substr(p_name, 3, p_partkey % 12)) AS needle, p_partkey % 3 AS way FROM part WHERE p_partkey % 12 > 0),
t AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS text, CASE WHEN p_size > 25 THEN 1 ELSE 2 END AS way FROM part),
m AS (SELECT t.p_partkey, min((rule_order, rule)) AS best FROM t JOIN r ON contains(t.text, r.needle) AND r.needle <> '' AND r.way IN (0, t.way) GROUP BY t.p_partkey)
SELECT t.p_partkey, best[1] AS rule_order, best[2] AS rule FROM t LEFT JOIN m USING (p_partkey)
"""
BANK_FACTS = f"""
WITH {_PRINTED}, s AS (SELECT account, coalesce(sum(debit), 0)::BIGINT AS d, coalesce(sum(credit), 0)::BIGINT AS c, arg_max(b, line_no) AS last, min(date) AS lo, max(date) AS hi FROM pr GROUP BY account)
SELECT account, ['Quayside', 'Ridgeway', NULL][account::INT % 3 + 1] AS bank, '62' || lpad(account, 9, '0') AS account_number, lo::VARCHAR AS period_start, hi::VARCHAR AS period_end,
       d AS all_debits, c AS all_credits, last AS closings FROM s
"""
PAGED_TABLES = f"""
WITH {_PRINTED},
x AS (SELECT *, account::INT % 3 AS k, (line_no - 1) // 4 AS page, (line_no - 1) % 4 + 1 AS place FROM pr)
SELECT account AS path, page, place + CASE WHEN page = 0 OR k = 2 THEN 1 ELSE 0 END AS row_no, date::VARCHAR AS day,
       CASE WHEN seq % 5 = 0 THEN '(no description)' ELSE description END AS description, debit, credit, b AS balance
FROM x WHERE seq % 11 <> 0 AND (k <> 1 OR page = 0)
"""
SPLIT_STATEMENTS = f"""
WITH {_PRINTED}, p AS (SELECT account, (line_no - 1) // 3 AS page, line_no FROM pr),
l AS (SELECT account, page, line_no FROM p UNION ALL SELECT DISTINCT account, page, 0 FROM p WHERE page % 2 = 0),
n AS (SELECT *, max(page // 2) OVER (PARTITION BY account) + 1 AS n FROM l)
SELECT account, page, line_no, account || CASE WHEN n > 1 THEN ' (statement ' || (page // 2 + 1) || ' of ' || n || ')' ELSE '' END AS statement FROM n
"""
WORD_LINES = """
WITH p AS (SELECT p_partkey // 40 AS page, p_partkey % 40 AS line, p_name FROM part)
SELECT page, row_number() OVER (PARTITION BY page ORDER BY line) AS line_no, p_name AS text FROM p
"""
PRINTED_FIGURES = """
WITH o AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS c, o_orderkey % 4 > 1 AS blanks FROM orders)
SELECT o_orderkey, 5::BIGINT AS n, 5 * c AS total, '? -1 -1 -1 1' AS signs, CASE WHEN blanks THEN 5 * (c % 100000) ELSE 5 * c END AS apart,
       12 + CASE WHEN blanks THEN 5 * CASE WHEN c >= 100000000 THEN 2 WHEN c >= 100000 THEN 1 ELSE 0 END ELSE 0 END AS last_word FROM o
"""
LEDGER_NAMES = """
WITH c AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN ' (statement 2 of 3)' ELSE '' END AS part, substr(sha256(c_name), 1, 12) AS h,
                  CASE WHEN c_custkey % 5 <> 0 THEN c_custkey::VARCHAR END AS a, CASE WHEN c_custkey % 7 <> 0 THEN 'A_B ' || c_mktsegment END AS who FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN h || ltrim(part) ELSE c_name || '.pdf' END AS statement_id,
       CASE WHEN a IS NOT NULL THEN coalesce(who || ' (' || a || ')', 'Account ' || a)
            ELSE coalesce(who, 'Unknown account') || ' - ' || CASE WHEN c_custkey % 2 = 0 THEN h || '_' ELSE '' END || c_name END AS ledger FROM c
"""
SESSION_STATS = f"""
WITH {LEDGER}
SELECT (SELECT count(*) FROM (SELECT DISTINCT account, month FROM ledger)) AS statements, count(*) AS rows, count(DISTINCT account) AS accounts, count(*) FILTER (status = 'REVIEW_REQUIRED') AS to_review,
       coalesce(sum(CASE WHEN vat = 'Yes' THEN {_vat("abs(signed)")} END), 0)::BIGINT AS vat FROM ledger
"""
DOMINANT_CATEGORY = f"""
WITH {LEDGER}, n AS (SELECT account, category, count(*) AS n FROM ledger GROUP BY account, category)
SELECT account, category FROM n QUALIFY row_number() OVER (PARTITION BY account ORDER BY n DESC, category) = 1
"""

ORACLES = {
    "monthly_summary": MONTHLY_SUMMARY,
    "monthly_total_rollup": MONTHLY_TOTAL_ROLLUP,
    "monthly_table": MONTHLY_TABLE,
    "balance_breaks": BALANCE_BREAKS,
    "workbook_gaps": WORKBOOK_GAPS,
    "opening_closing": OPENING_CLOSING,
    "flag_duplicates": FLAG_DUPLICATES,
    "flag_date_order": FLAG_DATE_ORDER,
    "confirm_groups": CONFIRM_GROUPS,
    "page_segments": PAGE_SEGMENTS,
    "missing_pages": MISSING_PAGES,
    "income_statement_pivot": INCOME_STATEMENT_PIVOT,
    "cash_flow": CASH_FLOW,
    "cash_flow_total": CASH_FLOW_TOTAL,
    "category_breakdown": CATEGORY_BREAKDOWN,
    "spend_by_category": SPEND_BY_CATEGORY,
    "vat_by_month": VAT_BY_MONTH,
    "vat_return": VAT_RETURN,
    "vat_return_by_period": VAT_RETURN_BY_PERIOD,
    "range_of_months": RANGE_OF_MONTHS,
    "vat_registration": VAT_REGISTRATION,
    "newest_files": NEWEST_FILES,
    "review_lines": REVIEW_LINES,
    "vat_summary": VAT_SUMMARY,
    "vat_net_lineitem": VAT_NET_LINEITEM,
    "month_vat_sheet": MONTH_VAT_SHEET,
    "period_summary": PERIOD_SUMMARY,
    "vat_periods_ab": VAT_PERIODS_AB,
    "overview": OVERVIEW,
    "money_chart": MONEY_CHART,
    "categorize_first_match": CATEGORIZE_FIRST_MATCH,
    "report_categories": REPORT_CATEGORIES,
    "row_key_dedup": ROW_KEY_DEDUP,
    "file_registry": FILE_REGISTRY,
    "mixed_accounts": MIXED_ACCOUNTS,
    "parse_amount_formats": PARSE_AMOUNT_FORMATS,
    "parse_date_formats": PARSE_DATE_FORMATS,
    "fiscal_calendar": FISCAL_CALENDAR,
    "same_words": SAME_WORDS,
    "telling_words": TELLING_WORDS,
    "garbled_figures": GARBLED_FIGURES,
    "rand_format": RAND_FORMAT,
    "learned_category": LEARNED_CATEGORY,
    "category_lifecycle": CATEGORY_LIFECYCLE,
    "assess_rows": ASSESS_ROWS,
    "assess_statements": ASSESS_STATEMENTS,
    "choose_reading": CHOOSE_READING,
    "compare_readings": COMPARE_READINGS,
    "read_lines": READ_LINES,
    "unknown_layouts": UNKNOWN_LAYOUTS,
    "yearless_dates": YEARLESS_DATES,
    "client_of_files": CLIENT_OF_FILES,
    "statement_styles": STATEMENT_STYLES,
    "statement_ledger": STATEMENT_LEDGER,
    "sheet_rows": SHEET_ROWS,
    "second_reading": SECOND_READING,
    "line_formats": LINE_FORMATS,
    "printed_totals": PRINTED_TOTALS,
    "vat_return_total": VAT_RETURN_TOTAL,
    "vat_summary_total": VAT_SUMMARY_TOTAL,
    "category_breakdown_month": CATEGORY_BREAKDOWN_MONTH,
    "entry_lines": ENTRY_LINES,
    "listed_lines": LISTED_LINES,
    "run_stats": RUN_STATS,
    "delimited_cells": DELIMITED_CELLS,
    "rule_table": RULE_TABLE,
    "bank_facts": BANK_FACTS,
    "paged_tables": PAGED_TABLES,
    "split_statements": SPLIT_STATEMENTS,
    "word_lines": WORD_LINES,
    "printed_figures": PRINTED_FIGURES,
    "ledger_names": LEDGER_NAMES,
    "session_stats": SESSION_STATS,
    "dominant_category": DOMINANT_CATEGORY,
}

