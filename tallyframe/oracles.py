"""The registered queries as plain SQL over the given tables.

Written from the definitions (row-level joins, window functions, OR joins),
not from the Spark plans, so that an error in a plan shows.
"""

from __future__ import annotations

from tallyframe import schema as S

TOTAL = "DECIMAL(26,2)"
MONEY = "DECIMAL(16,2)"
AS_OF = "DATE '1998-06-01'"


def _values(rows: list[tuple], names: str) -> str:
    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, (int, float)):
            return str(v)
        return "'" + str(v).replace("'", "''") + "'"

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + f") v({names})"


_SYSTEM = [
    (1, "salary", "INCOME"), (2, "freelance", "INCOME"), (3, "investment", "INCOME"), (5, "business", "INCOME"),
    (11, "food_dining", "OUTCOME"), (12, "transportation", "OUTCOME"), (13, "shopping", "OUTCOME"),
    (15, "bills_utilities", "OUTCOME"),
]
_LABELS = [(k, en, ru) for d in (S.OUTCOME_CATEGORY_LABELS, S.INCOME_CATEGORY_LABELS) for k, (en, ru) in d.items()]

_T = """SELECT o_orderkey AS id,
  CASE WHEN o_custkey % 50 <> 7 THEN o_custkey END AS user_id,
  CASE WHEN o_orderstatus = 'F' THEN 'INCOME' ELSE 'OUTCOME' END AS type,
  CAST(o_totalprice AS DECIMAL(16,2)) AS amount,
  CAST(o_orderdate AS DATE) AS date,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority || ' order' END AS description,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
       WHEN o_orderstatus <> 'F' AND o_custkey % 4 = 0 AND o_orderpriority = '5-LOW' THEN 1000 + o_custkey
       ELSE CAST(substr(o_orderpriority, 1, 1) AS BIGINT) + CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 10 END
  END AS category_id,
  CASE WHEN o_custkey % 50 <> 7 AND o_orderkey % 10 <> 0 THEN o_custkey * 3 + o_orderkey % 3 END AS account_id
FROM orders"""

# name -> (text, names it reads)
CTES: dict[str, tuple[str, list[str]]] = {
    "cur": (
        "SELECT CAST(id AS BIGINT) AS id, name, symbol FROM ("
        + _values([(i, n, s) for i, (n, s) in enumerate(S.SEED_CURRENCIES, 1)], "id, name, symbol") + ")", []),
    "labels": (_values(_LABELS, "key, en, ru"), []),
    "u": ("""SELECT c_custkey AS id, 'user' || c_custkey || '@example.com' AS email,
  CASE WHEN c_custkey % 13 <> 0 THEN CAST(c_nationkey % 20 + 1 AS BIGINT) END AS currency_id FROM customer""", []),
    "t": (_T, []),
    "raw": ("""SELECT id, user_id, CASE WHEN id % 211 = 0 THEN 'TRANSFER' WHEN id % 101 = 0 THEN 'OUTCOME' ELSE type END AS type,
  amount, date, description, category_id, CASE WHEN id % 89 = 0 THEN account_id + 3 ELSE account_id END AS account_id
FROM t""", ["t"]),
    "c": (
        "SELECT CAST(id AS BIGINT) AS id, name, type, TRUE AS is_system, CAST(NULL AS BIGINT) AS user_id FROM ("
        + _values(_SYSTEM, "id, name, type") + ") UNION ALL SELECT 1000 + c_custkey, lower(c_mktsegment), 'OUTCOME', FALSE, "
        "c_custkey FROM customer WHERE c_custkey % 4 = 0", []),
    "a": ("""SELECT c_custkey * 3 + k AS id, 'acct_' || k AS name,
  CASE k WHEN 0 THEN 'BANK' WHEN 1 THEN 'CASH' ELSE 'CREDIT_CARD' END AS account_type,
  CAST(CASE WHEN k = 0 THEN c_acctbal ELSE 0 END AS DECIMAL(16,2)) AS initial_balance,
  NOT (k = 2 AND c_custkey % 5 = 0) AS is_active,
  TIMESTAMP '2024-01-01 00:00:00' AS updated_at, c_custkey AS user_id
FROM customer CROSS JOIN (VALUES (0), (1), (2)) g(k)""", []),
    "b": ("""SELECT c_custkey * 10 + (y - 1995) AS id, 'budget_' || y AS name, 'YEARLY' AS period_type,
  make_date(y, 1, 1) AS start_date, make_date(y, 12, 31) AS end_date,
  CASE WHEN CAST(c_acctbal AS DECIMAL(16,2)) > 0 THEN CAST(CAST(c_acctbal AS DECIMAL(16,2)) * 50 AS DECIMAL(16,2)) END
    AS total_expense_limit,
  (c_custkey + y) % 4 <> 0 AS is_active, c_custkey AS user_id
FROM customer CROSS JOIN (VALUES (1995), (1996), (1997), (1998), (1999), (2000), (2001)) g(y)""", []),
    "l": ("""SELECT b.id * 100 + k AS id, b.id AS budget_id, CAST(k AS BIGINT) AS category_id,
  CAST(CASE WHEN b.user_id % 100 = 3 THEN 0 ELSE 10000 * (k - 10) END AS DECIMAL(16,2)) AS limit_amount
FROM b CROSS JOIN (VALUES (11), (12), (13), (15)) g(k)""", ["b"]),
    "r": ("""SELECT c_custkey AS id, c_custkey AS user_id, c_custkey * 3 AS account_id,
  CAST(100 + c_custkey % 10 AS DECIMAL(16,2)) AS amount,
  CASE WHEN c_custkey % 37 = 0 THEN 'INCOME' ELSE 'OUTCOME' END AS type,
  CASE WHEN c_custkey % 11 <> 0 THEN CAST(11 AS BIGINT) END AS category_id,
  CASE WHEN c_custkey % 5 <> 0 THEN 'rent' END AS description,
  CASE c_custkey % 4 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'monthly' ELSE 'yearly' END AS frequency,
  make_date(1995, CAST(1 + c_custkey % 12 AS INTEGER), CAST(1 + (c_custkey % 31) % 28 AS INTEGER)) AS start_date,
  CASE WHEN c_custkey % 6 = 0 THEN DATE '1997-12-31' END AS end_date
FROM customer""", []),
    "ev": ("""SELECT event_id AS id, CASE WHEN event_id % 97 <> 0 THEN user_id END AS user_id,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'INCOME' ELSE 'OUTCOME' END AS type,
  CAST(value AS DECIMAL(16,2)) AS amount, CAST(ts AS DATE) AS date FROM events""", []),
    # Sum of a budget's rows, row by row.
    "bt": (f"""SELECT b.id AS budget_id,
  CAST(COALESCE(SUM(CASE WHEN t.type = 'INCOME' THEN t.amount END), 0) AS {TOTAL}) AS income,
  CAST(COALESCE(SUM(CASE WHEN t.type = 'OUTCOME' THEN t.amount END), 0) AS {TOTAL}) AS spent
FROM b LEFT JOIN t ON t.user_id = b.user_id AND t.date BETWEEN b.start_date AND b.end_date GROUP BY b.id""", ["b", "t"]),
    "lt": (f"""SELECT l.id AS limit_id, CAST(COALESCE(SUM(t.amount), 0) AS {TOTAL}) AS spent
FROM l JOIN b ON b.id = l.budget_id
LEFT JOIN t ON t.user_id = b.user_id AND t.category_id = l.category_id AND t.type = 'OUTCOME'
  AND t.date BETWEEN b.start_date AND b.end_date GROUP BY l.id""", ["l", "b", "t"]),
    "acc": (f"""SELECT a.id, a.user_id, a.name, a.account_type, a.is_active, a.initial_balance, a.updated_at,
  CAST(COALESCE(SUM(CASE WHEN t.type = 'INCOME' THEN t.amount END), 0) AS {TOTAL}) AS inc,
  CAST(COALESCE(SUM(CASE WHEN t.type = 'OUTCOME' THEN t.amount END), 0) AS {TOTAL}) AS exp,
  COUNT(t.id) AS n, MIN(t.date) AS first_date, MAX(t.date) AS last_date
FROM a LEFT JOIN t ON t.account_id = a.id GROUP BY ALL""", ["a", "t"]),
    "st": (f"""SELECT id, user_id, name, account_type, is_active, initial_balance, updated_at,
  CAST(initial_balance + inc - exp AS {TOTAL}) AS balance FROM acc""", ["acc"]),
    "vis": ("""SELECT u.id AS user_id, u.email, c.id AS category_id, c.name AS category_name, c.type AS category_type, c.is_system
FROM u LEFT JOIN c ON c.user_id = u.id OR c.is_system""", ["u", "c"]),
    "cb": (f"""SELECT id, name, period_type, start_date, end_date, total_expense_limit, is_active, user_id FROM (
  SELECT b.*, row_number() OVER (PARTITION BY user_id ORDER BY start_date DESC, id DESC) AS rn FROM b
  WHERE is_active AND start_date <= {AS_OF} AND end_date >= {AS_OF} - 30) WHERE rn = 1""", ["b"]),
    "drafts": ("""SELECT id, CASE year(start_date) % 4 WHEN 0 THEN 'MONTHLY' WHEN 1 THEN 'QUARTERLY' WHEN 2 THEN 'YEARLY' ELSE 'CUSTOM' END
  AS period_type, CASE WHEN total_expense_limit IS NOT NULL THEN start_date END AS start_date,
  CASE WHEN is_active THEN end_date END AS end_date FROM b""", ["b"]),
    "bounds": ("""SELECT p, CASE p WHEN 'MONTHLY' THEN DATE '1998-06-01' WHEN 'QUARTERLY' THEN DATE '1998-04-01'
  WHEN 'YEARLY' THEN DATE '1998-01-01' END AS s, CASE p WHEN 'MONTHLY' THEN DATE '1998-06-30'
  WHEN 'QUARTERLY' THEN DATE '1998-06-30' WHEN 'YEARLY' THEN DATE '1998-12-31' END AS e
FROM (VALUES ('MONTHLY'), ('QUARTERLY'), ('YEARLY'), ('CUSTOM')) v(p)""", []),
    "rawchk": ("""SELECT raw.*, CASE WHEN raw.type NOT IN ('INCOME', 'OUTCOME') THEN 'invalid type'
  WHEN raw.account_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a WHERE a.id = raw.account_id AND a.user_id = raw.user_id)
  THEN 'account not found or access denied' END AS reason FROM raw""", ["raw", "a"]),
    "gone_c": ("SELECT id FROM c WHERE NOT is_system AND name IN ('machinery', 'furniture')", ["c"]),
    "made": ("""SELECT r.id, r.user_id, r.account_id, r.amount, r.type, r.category_id, r.description, d.day AS date
FROM r JOIN (SELECT CAST(g AS DATE) AS day FROM range(TIMESTAMP '1998-05-25', TIMESTAMP '1998-06-02', INTERVAL 1 DAY) s(g)) d
  ON r.start_date <= d.day AND (r.frequency = 'daily' OR (r.frequency = 'weekly' AND isodow(d.day) = 1)
    OR (r.frequency = 'monthly' AND day(d.day) = day(r.start_date))
    OR (r.frequency = 'yearly' AND day(d.day) = day(r.start_date) AND month(d.day) = month(r.start_date)))
LEFT JOIN c ON c.id = r.category_id
WHERE (r.category_id IS NULL OR c.type = r.type) AND NOT EXISTS (SELECT 1 FROM t WHERE t.date = d.day
  AND t.user_id IS NOT DISTINCT FROM r.user_id AND t.account_id IS NOT DISTINCT FROM r.account_id
  AND t.amount = r.amount AND t.type = r.type AND t.category_id IS NOT DISTINCT FROM r.category_id)""", ["r", "c", "t"]),
    "news": ("""SELECT id, name, CASE WHEN id % 19 = 0 THEN 'WALLET' ELSE account_type END AS account_type, initial_balance,
  is_active, updated_at, user_id FROM a WHERE id % 17 <> 0
UNION ALL SELECT 10000000 + user_id, 'acct_new', account_type, initial_balance, is_active, updated_at, user_id
FROM a WHERE account_type = 'BANK' AND user_id % 23 = 0""", ["a"]),
}


def _acc_json(p: str) -> str:
    return (
        f"""'{{"id":' || {p}.id || ',"name":"' || {p}.name || '","account_type":"' || {p}.account_type || '","initial_balance":'"""
        f""" || {p}.initial_balance || ',"is_active":' || {p}.is_active || ',"updated_at":"2024-01-01T00:00:00.000Z","user_id":'"""
        f""" || {p}.user_id || '}}'"""
    )


def _budget_json(p: str) -> str:
    return (
        f"""'{{"id":' || {p}.id || ',"name":"' || {p}.name || '","period_type":"' || {p}.period_type || '","start_date":"'"""
        f""" || {p}.start_date || '","end_date":"' || {p}.end_date || '","total_expense_limit":'"""
        f""" || COALESCE(CAST({p}.total_expense_limit AS VARCHAR), 'null') || ',"is_active":' || {p}.is_active || ',"user_id":'"""
        f""" || {p}.user_id || '}}'"""
    )


def _needed(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        for m in CTES[n][1]:
            visit(m)
        if n not in seen:
            seen.append(n)

    for n in names:
        visit(n)
    return seen


def _sql(ctes: str, body: str) -> str:
    parts = [f"{n} AS ({CTES[n][0]})" for n in _needed(ctes.split())]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


def _percent(part: str, whole: str) -> str:
    """Half-up percentage with two decimals in integer arithmetic."""
    p, w = f"CAST({part} * 100 AS HUGEINT)", f"CAST({whole} * 100 AS HUGEINT)"
    return f"CASE WHEN {whole} IS NOT NULL AND {whole} <> 0 THEN ((2 * 10000 * {p} + {w}) // (2 * {w})) / 100.0::DOUBLE END"


def _raw_percent(part: str, whole: str) -> str:
    return (
        f"CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100.0::DOUBLE ELSE 0.0::DOUBLE END"
    )


def _sum(kind: str, p: str = "") -> str:
    return f"CAST(COALESCE(SUM(CASE WHEN {p}type = '{kind}' THEN {p}amount END), 0) AS {TOTAL})"


def _day_month(d: str) -> str:
    return f"day({d}) || strftime({d}, '%b')"


def _week_label(monday: str) -> str:
    return f"{_day_month(monday)} || '-' || {_day_month(f'CAST({monday} + 6 AS DATE)')}"


_MONDAY = "CAST(date_trunc('week', date) AS DATE)"
_MONTHS = "['Jan.','Feb.','March','April','May','June','July','Aug.','Sept.','Oct.','Nov.','Dec.']"


def _list_date(d: str) -> str:
    return f"{_MONTHS}[month({d})] || ' ' || day({d}) || ', ' || year({d})"


def _cut(c: str, width: int = 20) -> str:
    return f"CASE WHEN length({c}) > {width} THEN substr({c}, 1, {width - 1}) || '…' ELSE {c} END"


def _label(p: str, lang: str = "en") -> str:
    return f"CASE WHEN {p}.is_system THEN COALESCE(labels.{lang}, {p}.name) ELSE {p}.name END"


_HEAT = f"""SELECT user_id, CAST(isoyear(date) AS INTEGER) AS iso_year, CAST(weekofyear(date) AS INTEGER) AS week,
  CAST(isodow(date) - 1 AS INTEGER) AS weekday_num, dayname(date) AS weekday, {_week_label(_MONDAY)} AS week_label,
  CAST(SUM(amount) AS {TOTAL}) AS heat FROM {{src}} WHERE type = 'OUTCOME' AND user_id IS NOT NULL GROUP BY ALL"""
_HEAT_EV = _HEAT.format(src="ev")


def _hex_draw(slot: int, n: str) -> str:
    return f"((CAST('0x' || substr(h, {slot * 5 + 1}, 5) AS BIGINT) * ({n})) >> 20)"


def _list_literal(texts: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in texts) + "]"


_GENERATED = f"""
, act AS (SELECT id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY id) - 1 AS no,
    COUNT(*) OVER (PARTITION BY user_id) AS n FROM a WHERE is_active),
own AS (SELECT id, user_id, type, row_number() OVER (PARTITION BY user_id, type ORDER BY id) - 1 AS no,
    COUNT(*) OVER (PARTITION BY user_id, type) AS n FROM c WHERE NOT is_system),
sys AS (SELECT id, type, row_number() OVER (PARTITION BY type ORDER BY id) - 1 AS no,
    COUNT(*) OVER (PARTITION BY type) AS n FROM c WHERE is_system),
h AS (SELECT u.id AS user_id, k.no AS row_no, md5('7/' || u.id || '/' || k.no) AS h
    FROM u CROSS JOIN (SELECT unnest(range(1, 51)) AS no) k WHERE u.id IN (SELECT user_id FROM act)),
d AS (SELECT *, CASE WHEN {_hex_draw(0, '100')} < 70 THEN 'OUTCOME' ELSE 'INCOME' END AS type FROM h),
n AS (SELECT d.*, (SELECT MAX(n) FROM act WHERE act.user_id = d.user_id) AS n_acc,
    COALESCE((SELECT MAX(n) FROM sys WHERE sys.type = d.type), 0) AS n_sys,
    COALESCE((SELECT MAX(n) FROM own WHERE own.type = d.type AND own.user_id = d.user_id), 0) AS n_own FROM d),
p AS (SELECT *, {_hex_draw(1, 'n_acc')} AS acc_no, {_hex_draw(2, 'n_sys + n_own')} AS cat_no FROM n)
SELECT p.user_id, CAST(row_no AS INTEGER) AS row_no, p.type,
  CAST(CASE WHEN p.type = 'INCOME' THEN {_hex_draw(4, '490001')} + 10000 ELSE {_hex_draw(4, '49001')} + 1000 END
    * 0.01 AS {MONEY}) AS amount,
  CAST(DATE '2024-01-30' - 60 + CAST({_hex_draw(3, '61')} AS INTEGER) AS DATE) AS date,
  CASE WHEN p.type = 'INCOME' THEN {_list_literal(S.INCOME_DESCRIPTIONS)}[{_hex_draw(5, '8')} + 1]
    ELSE {_list_literal(S.OUTCOME_DESCRIPTIONS)}[{_hex_draw(5, '14')} + 1] END AS description,
  COALESCE(sys.id, own.id) AS category_id, act.id AS account_id
FROM p JOIN act ON act.user_id = p.user_id AND act.no = acc_no
LEFT JOIN sys ON sys.type = p.type AND sys.no = cat_no
LEFT JOIN own ON own.user_id = p.user_id AND own.type = p.type AND own.no = cat_no - n_sys
WHERE COALESCE(sys.id, own.id) IS NOT NULL"""

_SUFFIX = S.RECURRING_SUFFIX
_MADE_COLUMNS = f"""user_id, type, amount, date, COALESCE(description, 'None') || '{_SUFFIX}' AS description, category_id, account_id"""


def _seed(rows: list[tuple[str, str]], keep: str, missing: str) -> str:
    wanted = _values([(i, n, k) for i, (n, k) in enumerate(rows, 1)], "no, name, type")
    return f"""SELECT * FROM c WHERE {keep} UNION ALL
SELECT w.no + (SELECT MAX(id) FROM c), w.name, w.type, TRUE, CAST(NULL AS BIGINT) FROM ({wanted}) w WHERE {missing}"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    keyed = [(k, "OUTCOME") for k in S.OUTCOME_CATEGORY_LABELS] + [(k, "INCOME") for k in S.INCOME_CATEGORY_LABELS]

    # --- sources and sinks
    q["scan_ledger"] = _sql("t", "SELECT * FROM t")
    q["seed_dimensions"] = _sql("c", _seed(keyed, "TRUE", "w.name NOT IN (SELECT name FROM c WHERE is_system)"))
    q["seed_currencies"] = _sql("cur u r", """
, ex AS (SELECT * FROM cur WHERE id IN (SELECT u.currency_id FROM u JOIN r ON r.user_id = u.id WHERE r.type = 'INCOME'))
SELECT * FROM ex UNION ALL SELECT id + (SELECT COALESCE(MAX(id), 0) FROM ex), name, symbol FROM cur WHERE name NOT IN (SELECT name FROM ex)""")
    q["reset_system_categories"] = _sql("c", _seed(S.RESET_CATEGORIES, "NOT is_system", "TRUE"))
    q["generate_transactions"] = _sql("u a c", _GENERATED)
    q["generate_transactions_table"] = _sql("u a c t", f"""{_GENERATED.replace("SELECT p.user_id", ", g AS (SELECT p.user_id", 1)})
SELECT (SELECT MAX(id) FROM t) + row_number() OVER (ORDER BY user_id, row_no) AS id, user_id, type, amount, date, description,
  category_id, account_id FROM g""")
    q["append_transactions_once"] = _sql("t", "SELECT *, CAST(date_trunc('month', date) AS DATE) AS month FROM t")
    state = "SELECT {v}::BIGINT AS version, '{n}' AS table_name, COUNT(*) AS row_count, CAST(SUM(id) AS BIGINT) AS id_sum FROM {n1} WHERE {w}"
    gone = ["TRUE", "total_expense_limit IS NOT NULL", "total_expense_limit IS NOT NULL AND name <> 'budget_1997'"]
    q["versioned_changes"] = _sql("t b l c", " UNION ALL ".join(
        state.format(v=v, n=n, n1=n1, w=w)
        for v in (1, 2, 3) for n, n1, w in (
            ("transactions", "t", "TRUE"), ("categories", "c", "TRUE"), ("budgets", "b", gone[v - 1]),
            ("limits", "l", f"budget_id IN (SELECT id FROM b WHERE {gone[v - 1]})"))))
    q["append_transactions"] = _sql("t", "SELECT *, CAST(date_trunc('month', date) AS DATE) AS month FROM t")
    q["export_transactions_json"] = _sql("t", """SELECT id, '{"id":' || id || ',"type":"' || type || '","amount":"' || amount
  || '","date":"' || date || '","description":' || COALESCE('"' || description || '"', 'null') || ',"category":'
  || COALESCE(CAST(category_id AS VARCHAR), 'null') || '}' AS json FROM t""")
    q["export_categories_json"] = _sql("c", """SELECT id, '{"id":' || id || ',"name":"' || name || '","type":"' || type
  || '","is_system":' || is_system || '}' AS json FROM c""")
    q["chart_series"] = _sql("t", f"""SELECT user_id, string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) AS labels,
  string_agg(CAST(inc AS VARCHAR), ',' ORDER BY date) AS income_data,
  string_agg(CAST(exp AS VARCHAR), ',' ORDER BY date) AS expense_data
FROM (SELECT user_id, date, {_sum('INCOME')} AS inc, {_sum('OUTCOME')} AS exp FROM t WHERE user_id IS NOT NULL
  GROUP BY user_id, date) GROUP BY user_id""")

    # --- filters and projections
    q["filter_by_user"] = _sql("t", "SELECT * FROM t WHERE user_id = 44")
    q["filter_by_account"] = _sql("t a", """SELECT * FROM t WHERE account_id = 133
  AND account_id IN (SELECT id FROM a WHERE user_id = 44 AND is_active)""")
    q["filter_by_type"] = _sql("t", "SELECT * FROM t WHERE type = 'INCOME'")
    q["filter_by_category"] = _sql("t", "SELECT * FROM t WHERE category_id IS NULL")
    q["filter_by_date_range"] = _sql("t", "SELECT * FROM t WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'")
    q["filter_by_description"] = _sql("t", "SELECT * FROM t WHERE contains(lower(description), 'urgent')")
    q["transaction_search"] = _sql("t", """SELECT * FROM t WHERE type = 'OUTCOME' AND category_id = 11
  AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND contains(lower(description), '1-urgent')""")
    q["visible_categories"] = _sql("c", "SELECT * FROM c WHERE (is_system OR user_id = 44) AND type = 'OUTCOME'")
    q["categories_by_type"] = _sql("c", "SELECT * FROM c WHERE type = 'OUTCOME'")
    q["active_accounts"] = _sql("a", "SELECT * FROM a WHERE is_active")
    q["budget_transactions"] = _sql("b t c a labels", f"""SELECT b.id AS budget_id, t.id, t.date, t.type, t.amount, t.description,
  {_label('c')} AS category_label, a.name AS account_name
FROM b JOIN t ON t.user_id = b.user_id AND t.date BETWEEN b.start_date AND b.end_date
LEFT JOIN c ON c.id = t.category_id LEFT JOIN labels ON labels.key = c.name LEFT JOIN a ON a.id = t.account_id""")
    q["current_budget_candidates"] = _sql("b", f"""SELECT * FROM b WHERE is_active AND start_date <= {AS_OF}
  AND end_date >= {AS_OF} - 30""")
    due = """r.start_date <= d AND (r.frequency = 'daily' OR (r.frequency = 'weekly' AND isodow(d) = 1)
  OR (r.frequency = 'monthly' AND day(d) = day(r.start_date))
  OR (r.frequency = 'yearly' AND day(d) = day(r.start_date) AND month(d) = month(r.start_date)))"""
    q["recurring_due"] = _sql("r", f"SELECT r.*, d AS date FROM r CROSS JOIN (SELECT {AS_OF} AS d) WHERE {due}")
    q["recurring_due_range"] = _sql("r", f"""SELECT r.id, d AS date, r.frequency FROM r CROSS JOIN (
  SELECT CAST(g AS DATE) AS d FROM range(TIMESTAMP '1998-05-20', TIMESTAMP '1998-06-02', INTERVAL 1 DAY) s(g)) WHERE {due}""")
    q["signed_amount"] = _sql("t", """SELECT id, type, amount, CAST(CASE WHEN type = 'INCOME' THEN amount ELSE -amount END
  AS DECIMAL(16,2)) AS signed_amount FROM t""")
    q["period_bounds"] = _sql("drafts bounds", """SELECT id, period_type, s AS period_start, e AS period_end
FROM drafts JOIN bounds ON p = period_type""")
    q["budget_default_dates"] = _sql("drafts bounds", """SELECT id, period_type, COALESCE(start_date, s) AS start_date,
  COALESCE(end_date, e) AS end_date FROM drafts JOIN bounds ON p = period_type""")
    q["transaction_display"] = _sql("t u c cur labels", f"""SELECT t.id, t.user_id,
  COALESCE(NULLIF({_label('c')}, ''), 'None') AS category_text,
  CAST(t.amount AS VARCHAR) || ' ' || COALESCE(cur.symbol, '') AS amount_text, {_list_date('t.date')} AS date_text,
  {_cut("COALESCE(t.description, 'None')")} AS description_text
FROM t LEFT JOIN c ON c.id = t.category_id LEFT JOIN labels ON labels.key = c.name
LEFT JOIN u ON u.id = t.user_id LEFT JOIN cur ON cur.id = u.currency_id""")

    # --- joins
    q["user_category_matrix"] = _sql("vis", "SELECT * FROM vis")
    q["budget_transaction_join"] = _sql("b t", """SELECT b.id AS budget_id, b.user_id, t.id AS transaction_id, t.type, t.amount, t.date
FROM b LEFT JOIN t ON t.user_id = b.user_id AND t.date BETWEEN b.start_date AND b.end_date""")
    q["recurring_antijoin"] = _sql("r t", f"""
, ex AS (SELECT user_id, account_id, amount, type, category_id, date FROM t UNION ALL
  SELECT user_id, account_id, amount, type, category_id, d FROM r CROSS JOIN (SELECT {AS_OF} AS d)
  WHERE {due} AND frequency = 'monthly')
SELECT MIN(id) AS id, user_id, account_id, amount, type, category_id, d AS date FROM r CROSS JOIN (SELECT {AS_OF} AS d)
WHERE {due} AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.date = d AND ex.user_id IS NOT DISTINCT FROM r.user_id
  AND ex.account_id IS NOT DISTINCT FROM r.account_id AND ex.amount = r.amount AND ex.type = r.type
  AND ex.category_id IS NOT DISTINCT FROM r.category_id)
GROUP BY user_id, account_id, amount, type, category_id, d""")
    q["budget_categories"] = _sql("c l", "SELECT * FROM c WHERE id IN (SELECT category_id FROM l)")
    q["transaction_enriched"] = _sql("t c a u labels", f"""SELECT t.id, t.user_id, u.email, t.type, t.amount, t.date, t.category_id,
  c.name AS category_name, {_label('c')} AS category_label, t.account_id, a.name AS account_name
FROM t LEFT JOIN c ON c.id = t.category_id LEFT JOIN labels ON labels.key = c.name
LEFT JOIN a ON a.id = t.account_id LEFT JOIN u ON u.id = t.user_id""")
    q["category_labels"] = _sql("c labels", f"SELECT c.*, {_label('c', 'ru')} AS label FROM c LEFT JOIN labels ON labels.key = c.name")
    q["heatmap_grid"] = _sql("ev", f"""
, cells AS ({_HEAT_EV}), weeks AS (SELECT DISTINCT user_id, iso_year, week, week_label FROM cells),
days AS (SELECT * FROM (VALUES (0,'Monday'),(1,'Tuesday'),(2,'Wednesday'),(3,'Thursday'),(4,'Friday'),(5,'Saturday'),(6,'Sunday')) v(n, name))
SELECT w.user_id, w.iso_year, w.week, w.week_label, CAST(n AS INTEGER) AS weekday_num, name AS weekday, heat
FROM weeks w CROSS JOIN days LEFT JOIN cells ON cells.user_id = w.user_id AND cells.iso_year = w.iso_year
  AND cells.week = w.week AND cells.weekday_num = n""")
    q["account_ownership_check"] = _sql("raw a", """SELECT id, account_id IS NULL OR EXISTS (SELECT 1 FROM a
  WHERE a.id = raw.account_id AND a.user_id = raw.user_id) AS account_ok FROM raw""")
    q["user_currency"] = _sql("u cur", """SELECT u.id, u.email, u.currency_id, cur.symbol FROM u
LEFT JOIN cur ON cur.id = u.currency_id""")

    # --- reports and aggregations
    q["monthly_income_expense"] = _sql("u t", f"""SELECT u.id AS user_id, u.email, CAST(date_trunc('month', t.date) AS DATE) AS month,
  {_sum('INCOME', 't.')} AS total_income, {_sum('OUTCOME', 't.')} AS total_expense,
  CAST({_sum('INCOME', 't.')} - {_sum('OUTCOME', 't.')} AS {TOTAL}) AS net_amount,
  COUNT(CASE WHEN t.type = 'INCOME' THEN 1 END) AS income_count, COUNT(CASE WHEN t.type = 'OUTCOME' THEN 1 END) AS expense_count
FROM u LEFT JOIN t ON t.user_id = u.id GROUP BY ALL""")
    q["category_report"] = _sql("vis t", f"""SELECT vis.user_id, email, vis.category_id, category_name, category_type,
  CAST(date_trunc('month', t.date) AS DATE) AS month, COUNT(t.id) AS transaction_count,
  CAST(COALESCE(SUM(t.amount), 0) AS {TOTAL}) AS total_amount,
  COALESCE(CAST(SUM(t.amount) AS DOUBLE) / COUNT(t.id), 0.0::DOUBLE) AS avg_amount,
  CAST(COALESCE(MIN(t.amount), 0) AS {MONEY}) AS min_amount, CAST(COALESCE(MAX(t.amount), 0) AS {MONEY}) AS max_amount
FROM vis LEFT JOIN t ON t.category_id = vis.category_id AND t.user_id = vis.user_id
GROUP BY vis.user_id, email, vis.category_id, category_name, category_type, CAST(date_trunc('month', t.date) AS DATE)""")
    q["account_balance_report"] = _sql("acc st u cur", """SELECT acc.id AS account_id, acc.name AS account_name, acc.account_type,
  cur.symbol AS currency, st.balance AS current_balance, acc.initial_balance, acc.user_id, u.email, acc.inc AS total_income,
  acc.exp AS total_expense, acc.n AS transaction_count, acc.first_date AS first_transaction_date,
  acc.last_date AS last_transaction_date
FROM acc JOIN st ON st.id = acc.id JOIN u ON u.id = acc.user_id LEFT JOIN cur ON cur.id = u.currency_id WHERE acc.is_active""")
    q["budget_execution"] = _sql("b u bt", f"""SELECT b.id AS budget_id, b.name AS budget_name, period_type, start_date, end_date,
  total_expense_limit, b.user_id, email, income AS actual_income, spent AS actual_expense,
  CAST(total_expense_limit - spent AS {TOTAL}) AS expense_remaining,
  {_percent('spent', 'total_expense_limit')} AS expense_percentage_used
FROM b JOIN u ON u.id = b.user_id JOIN bt ON bt.budget_id = b.id WHERE b.is_active""")
    q["budget_limit_check"] = _sql("l b c lt", f"""SELECT l.budget_id, b.user_id, l.category_id, c.name AS category_name, l.limit_amount,
  spent AS spent_amount, CAST(l.limit_amount - spent AS {TOTAL}) AS remaining_amount,
  {_percent('spent', 'l.limit_amount')} AS percentage_used, spent > l.limit_amount AS is_exceeded
FROM l JOIN b ON b.id = l.budget_id JOIN c ON c.id = l.category_id JOIN lt ON lt.limit_id = l.id""")
    q["period_totals"] = _sql("ev", f"""SELECT user_id, {_sum('INCOME')} AS total_income, {_sum('OUTCOME')} AS total_expense,
  CAST({_sum('INCOME')} - {_sum('OUTCOME')} AS {TOTAL}) AS balance FROM ev WHERE user_id IS NOT NULL GROUP BY user_id""")
    q["daily_income_expense"] = _sql("t", f"""SELECT user_id, date AS day, {_sum('INCOME')} AS income, {_sum('OUTCOME')} AS expense
FROM t WHERE user_id IS NOT NULL GROUP BY user_id, date""")
    for key, lang, measure in (
        ("expense_by_category", "en", f"CAST(SUM(t.amount) AS {TOTAL}) AS total"),
        ("expense_frequency", "ru", "COUNT(*) AS count"),
    ):
        q[key] = _sql("t c labels", f"""SELECT t.user_id, t.category_id, COALESCE({_label('c', lang)}, 'Other') AS category, {measure}
FROM t LEFT JOIN c ON c.id = t.category_id LEFT JOIN labels ON labels.key = c.name
WHERE t.type = 'OUTCOME' AND t.user_id IS NOT NULL GROUP BY ALL""")
    q["expense_heatmap"] = _sql("t", _HEAT.format(src="t"))
    # Week w of the year starts w-1 weeks after the year's first Monday.
    first_monday = "(make_date(iso_year, 1, 1) + CAST((8 - isodow(make_date(iso_year, 1, 1))) % 7 AS INTEGER))"
    monday = f"CAST({first_monday} + CAST(7 * (week - 1) AS INTEGER) AS DATE)"
    q["expense_heatmap_week_of_year"] = _sql("t", f""", h AS ({_HEAT.format(src='t')})
SELECT user_id, iso_year, week, weekday_num, weekday, {_week_label(monday)} AS week_label, heat FROM h""")
    q["heatmap_week_labels"] = _sql("ev", f"SELECT DISTINCT user_id, iso_year, week, week_label FROM ({_HEAT_EV})")
    q["total_active_balance"] = _sql("u st", f"""SELECT u.id AS user_id, CAST(COALESCE(SUM(balance), 0) AS {TOTAL}) AS total_balance
FROM u LEFT JOIN st ON st.user_id = u.id AND st.is_active GROUP BY u.id""")
    q["budget_progress"] = _sql("b bt", f"""SELECT b.id AS budget_id, b.user_id, spent, income,
  CAST(CASE WHEN total_expense_limit <> 0 THEN total_expense_limit - spent ELSE 0 END AS {TOTAL}) AS remaining,
  CAST(COALESCE(total_expense_limit, 0) AS {TOTAL}) AS total_limit,
  {_raw_percent('spent', 'total_expense_limit')} AS percentage FROM b JOIN bt ON bt.budget_id = b.id""")
    q["category_limit_progress"] = _sql("l lt", f"""SELECT l.id AS limit_id, l.budget_id, l.category_id, l.limit_amount, spent,
  CAST(l.limit_amount - spent AS {TOTAL}) AS remaining, LEAST({_raw_percent('spent', 'l.limit_amount')}, 100.0::DOUBLE) AS percentage,
  spent > l.limit_amount AS over_budget FROM l JOIN lt ON lt.limit_id = l.id""")
    q["recompute_balances"] = _sql("st", "SELECT id AS account_id, user_id, initial_balance, balance FROM st")
    upto = f"""a.id AS account_id, CAST(a.initial_balance + COALESCE(SUM(CASE WHEN t.type = 'INCOME' THEN t.amount ELSE -t.amount END), 0)
  AS {TOTAL}) AS balance"""
    q["balance_on_date"] = _sql("a t", f"""SELECT {upto}, a.user_id, a.initial_balance, {AS_OF} AS date
FROM a LEFT JOIN t ON t.account_id = a.id AND t.date <= {AS_OF} GROUP BY a.id, a.user_id, a.initial_balance""")
    q["sql_balance_on_date"] = f"SELECT account_id, balance FROM ({q['balance_on_date']})"
    q["sql_limit_check"] = f"SELECT * FROM ({q['budget_limit_check']})"
    q["balance_at_requests"] = _sql("a t", f"""SELECT {upto}, q.date
FROM (SELECT DISTINCT account_id, last_day(date) AS date FROM t WHERE account_id IS NOT NULL) q
JOIN a ON a.id = q.account_id LEFT JOIN t ON t.account_id = a.id AND t.date <= q.date GROUP BY a.id, a.initial_balance, q.date""")
    q["account_transaction_counts"] = _sql("acc", "SELECT id AS account_id, user_id, n AS transaction_count FROM acc")
    q["account_detail_totals"] = _sql("acc", f"""SELECT id AS account_id, user_id, inc AS income_total, exp AS outcome_total,
  CAST(inc - exp AS {TOTAL}) AS net_change FROM acc""")
    q["dashboard_summary"] = _sql("u t st cb bt", f"""SELECT u.id AS user_id,
  CAST(COALESCE((SELECT SUM(amount) FROM t WHERE t.user_id = u.id AND type = 'INCOME' AND date BETWEEN {AS_OF} - 30 AND {AS_OF}), 0)
    AS {TOTAL}) AS total_income,
  CAST(COALESCE((SELECT SUM(amount) FROM t WHERE t.user_id = u.id AND type = 'OUTCOME' AND date BETWEEN {AS_OF} - 30 AND {AS_OF}), 0)
    AS {TOTAL}) AS total_expense,
  CAST(COALESCE((SELECT SUM(balance) FROM st WHERE st.user_id = u.id AND is_active), 0) AS {TOTAL}) AS balance,
  cb.id AS budget_id, cb.name AS budget_name, bt.spent AS budget_spent, bt.income AS budget_income,
  CAST(cb.total_expense_limit - bt.spent AS {TOTAL}) AS budget_remaining, cb.total_expense_limit AS budget_limit,
  {_percent('bt.spent', 'cb.total_expense_limit')} AS budget_percentage
FROM u LEFT JOIN cb ON cb.user_id = u.id LEFT JOIN bt ON bt.budget_id = cb.id""")
    q["dashboard_limit_lines"] = _sql("cb l lt c labels", f"""SELECT cb.user_id, cb.id AS budget_id, l.category_id,
  {_label('c')} AS category, spent AS total, l.limit_amount AS "limit", COALESCE({_percent('spent', 'l.limit_amount')}, 0.0::DOUBLE)
  AS usage_percent FROM cb JOIN l ON l.budget_id = cb.id JOIN lt ON lt.limit_id = l.id JOIN c ON c.id = l.category_id
LEFT JOIN labels ON labels.key = c.name""")
    none = "CAST(NULL AS BIGINT)"
    q["stats_bundle"] = _sql("t c labels", f"""
, f AS (SELECT * FROM t WHERE user_id IS NOT NULL AND date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31')
SELECT user_id, 'total' AS section, CAST(NULL AS DATE) AS date, {none} AS category_id, CAST(NULL AS VARCHAR) AS category,
  {_sum('INCOME')} AS income, {_sum('OUTCOME')} AS expense, CAST({_sum('INCOME')} - {_sum('OUTCOME')} AS {TOTAL}) AS balance,
  {none} AS frequency, CAST(NULL AS INTEGER) AS iso_year, CAST(NULL AS INTEGER) AS week, CAST(NULL AS INTEGER) AS weekday_num,
  CAST(NULL AS VARCHAR) AS week_label FROM f GROUP BY user_id
UNION ALL SELECT user_id, 'day', date, NULL, NULL, inc, exp, NULL, NULL,
  CASE WHEN n > 0 THEN CAST(isoyear(date) AS INTEGER) END, CASE WHEN n > 0 THEN CAST(weekofyear(date) AS INTEGER) END,
  CASE WHEN n > 0 THEN CAST(isodow(date) - 1 AS INTEGER) END, CASE WHEN n > 0 THEN {_week_label(_MONDAY)} END
FROM (SELECT user_id, date, {_sum('INCOME')} AS inc, {_sum('OUTCOME')} AS exp, COUNT(CASE WHEN type = 'OUTCOME' THEN 1 END) AS n
  FROM f GROUP BY user_id, date)
UNION ALL SELECT f.user_id, 'category', NULL, f.category_id, COALESCE({_label('c')}, 'Other'), NULL, CAST(SUM(f.amount) AS {TOTAL}),
  NULL, COUNT(*), NULL, NULL, NULL, NULL
FROM f LEFT JOIN c ON c.id = f.category_id LEFT JOIN labels ON labels.key = c.name WHERE f.type = 'OUTCOME'
GROUP BY f.user_id, f.category_id, COALESCE({_label('c')}, 'Other')""")

    # --- windows, orders, sets
    q["current_budget"] = _sql("cb", "SELECT * FROM cb")
    q["running_balance"] = _sql("a t", f"""
, dd AS (SELECT account_id, date, CAST(SUM(CASE WHEN type = 'INCOME' THEN amount ELSE -amount END) AS {TOTAL}) AS change
  FROM t WHERE account_id IS NOT NULL GROUP BY account_id, date)
SELECT account_id, date, change, CAST(a.initial_balance + SUM(change) OVER (PARTITION BY account_id ORDER BY date) AS {TOTAL}) AS balance
FROM dd JOIN a ON a.id = dd.account_id""")
    q["transaction_page"] = _sql("t", """SELECT * FROM (SELECT t.*, CAST(row_number() OVER (PARTITION BY user_id
  ORDER BY date DESC, id DESC) AS INTEGER) AS position FROM t WHERE user_id IS NOT NULL) WHERE position BETWEEN 6 AND 10""")
    q["sort_transactions"] = _sql("t", "SELECT id, amount, date FROM t ORDER BY amount DESC, id DESC")
    q["recent_transactions"] = _sql("t", "SELECT * FROM t ORDER BY date DESC, id DESC LIMIT 50")
    q["account_list"] = _sql("a", """SELECT id, user_id, name, CASE account_type WHEN 'BANK' THEN 'Bank Account' WHEN 'CASH' THEN 'Cash'
  ELSE 'Credit Card' END AS account_type_label, initial_balance, is_active FROM a""")
    q["budget_list"] = _sql("b", """SELECT id, user_id, name, 'Yearly' AS period_label, strftime(start_date, '%b %d, %Y') AS start_text,
  strftime(end_date, '%b %d, %Y') AS end_text, start_date, total_expense_limit FROM b""")
    q["recurring_list"] = _sql("r c labels", f"""SELECT r.id, r.user_id, r.type, COALESCE({_label('c')}, 'None') AS category_text,
  {_list_date('r.start_date')} AS start_text, COALESCE({_list_date('r.end_date')}, 'None') AS end_text, amount, frequency,
  {_cut("COALESCE(description, 'None')")} AS description_text
FROM r LEFT JOIN c ON c.id = r.category_id LEFT JOIN labels ON labels.key = c.name""")
    q["day_labels"] = _sql("t", "SELECT DISTINCT user_id, CAST(date AS VARCHAR) AS day FROM t")
    q["scalar_functions"] = _sql("t", f"""SELECT id, CAST(date_trunc('month', date) AS DATE) AS month, CAST(isoyear(date) AS INTEGER) AS iso_year,
  CAST(weekofyear(date) AS INTEGER) AS week, CAST(isodow(date) - 1 AS INTEGER) AS weekday_num, dayname(date) AS weekday,
  {_week_label(_MONDAY)} AS week_label, strftime(date, '%b %d, %Y') AS short_date, strftime(date, '%B %d, %Y') AS long_date,
  {_list_date('date')} AS list_date, {_cut('description', 10)} AS cut, COALESCE(NULLIF(description, ''), '-') AS description_or_dash,
  COALESCE(contains(lower(description), 'high'), FALSE) AS has_high,
  CAST(CASE WHEN type = 'INCOME' THEN amount ELSE -amount END AS DECIMAL(16,2)) AS signed_amount,
  CAST(CAST((CAST(amount * 100 AS BIGINT) + 5000) // 10000 AS BIGINT) // 10 AS VARCHAR) || '.' ||
    CAST(((CAST(amount * 100 AS BIGINT) + 5000) // 10000) % 10 AS VARCHAR) AS thousands_text,
  LEAST(CAST(amount AS DOUBLE) / 1000, 100.0::DOUBLE) AS clamped, CAST(date - 30 AS DATE) AS window_start,
  CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end FROM t""")

    # --- table changes
    status = "CASE WHEN reason IS NULL THEN 'ok' ELSE 'rejected' END AS status, reason"
    q["ingest_transactions"] = _sql("rawchk", f"SELECT id, {status} FROM rawchk")
    q["ingest_transactions_balances"] = _sql("rawchk st", f"""SELECT st.id, CAST(balance + COALESCE(SUM(CASE WHEN x.type = 'INCOME'
  THEN x.amount ELSE -x.amount END), 0) AS {TOTAL}) AS balance,
  CASE WHEN COUNT(x.id) > 0 THEN TIMESTAMP '2024-02-01 00:00:00' ELSE st.updated_at END AS updated_at
FROM st LEFT JOIN (SELECT * FROM rawchk WHERE reason IS NULL) x ON x.account_id = st.id GROUP BY st.id, balance, st.updated_at""")
    wanted = """, req AS (SELECT id AS request_id, user_id, type, CASE WHEN id % 53 <> 0 THEN amount END AS amount,
  CASE WHEN id % 59 <> 0 THEN date END AS date, description, CASE WHEN id % 61 = 0 THEN 999 ELSE category_id END AS category_id, account_id FROM raw),
judged AS (SELECT *, CASE WHEN type NOT IN ('INCOME', 'OUTCOME') THEN 'invalid type' WHEN amount IS NULL THEN 'amount required'
  WHEN date IS NULL THEN 'date required'
  WHEN account_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a WHERE a.id = req.account_id AND a.user_id = req.user_id)
  THEN 'account not found or access denied'
  WHEN category_id IS NOT NULL AND category_id NOT IN (SELECT id FROM c) THEN 'category not found' END AS reason FROM req),
new AS (SELECT (SELECT MAX(id) FROM t) + row_number() OVER (ORDER BY request_id) AS id, * FROM judged WHERE reason IS NULL)"""
    columns = "id, user_id, type, amount, date, description, category_id, account_id"
    q["ingest_transactions_table"] = _sql("raw a c t", f"{wanted} SELECT {columns} FROM t UNION ALL SELECT {columns} FROM new")
    q["ingest_transactions_requests"] = _sql("raw a c t", f"""{wanted}
SELECT judged.request_id, new.id, CASE WHEN judged.reason IS NULL THEN 'ok' ELSE 'rejected' END AS status, judged.reason
FROM judged LEFT JOIN new USING (request_id)""")
    q["ingest_transactions_new_balances"] = _sql("raw a c t st", f"""{wanted} SELECT st.id, CAST(balance + COALESCE(SUM(
  CASE WHEN n.type = 'INCOME' THEN n.amount ELSE -n.amount END), 0) AS {TOTAL}) AS balance,
  CASE WHEN COUNT(n.id) > 0 THEN TIMESTAMP '2024-02-01 00:00:00' ELSE st.updated_at END AS updated_at
FROM st LEFT JOIN new n ON n.account_id = st.id GROUP BY st.id, balance, st.updated_at""")
    q["ingest_transactions_refused"] = _sql("rawchk", f"""SELECT id, {status}, reason IS NULL OR id % 2 = 0 AS is_stored FROM (
  SELECT id, CASE WHEN id % 2 = 0 THEN 'id already used' WHEN id % 154 = 77 THEN 'id given more than once' ELSE reason END AS reason
  FROM (SELECT * FROM rawchk UNION ALL SELECT * FROM rawchk WHERE id % 154 = 77))""")
    cats = """, req AS (SELECT u.id * 10 + g.no AS request_id, u.id AS user_id, g.type,
    CASE g.no WHEN 0 THEN 'machinery' WHEN 3 THEN '' WHEN 4 THEN 'gifts ' || u.id % 7 ELSE 'pets' END AS name
  FROM u CROSS JOIN (VALUES (0, 'OUTCOME'), (1, 'OUTCOME'), (2, 'INCOME'), (3, 'INCOME'), (4, 'TRANSFER')) g(no, type)),
judged AS (SELECT *, CASE WHEN name = '' THEN 'name required' WHEN type = 'TRANSFER' THEN 'invalid type'
  WHEN request_id % 10 = 2 OR EXISTS (SELECT 1 FROM c WHERE c.name = req.name AND c.user_id = req.user_id) THEN 'name already used' END AS reason FROM req),
new AS (SELECT (SELECT MAX(id) FROM c) + row_number() OVER (ORDER BY request_id) AS id, * FROM judged WHERE reason IS NULL)"""
    reported = """SELECT judged.request_id, new.id, CASE WHEN judged.reason IS NULL THEN 'ok' ELSE 'rejected' END AS status, judged.reason
FROM judged LEFT JOIN new USING (request_id)"""
    q["create_categories"] = _sql("u c", f"{cats} SELECT * FROM c UNION ALL SELECT id, name, type, FALSE, user_id FROM new")
    q["create_categories_report"] = _sql("u c", f"{cats} {reported}")
    plans = f""", req AS (SELECT id AS request_id, CASE WHEN id % 13 = 0 THEN user_id + 1 ELSE user_id END AS user_id,
  CASE WHEN id % 17 <> 0 THEN id END AS account_id, CAST(CASE WHEN id % 19 <> 0 THEN 25 END AS {MONEY}) AS amount,
  CASE WHEN id % 23 = 0 THEN 'INCOME' ELSE 'OUTCOME' END AS type,
  CASE WHEN id % 5 = 0 THEN user_id + 1000 WHEN id % 5 <> 1 THEN 11 END AS category_id, 'plan' AS description,
  CASE WHEN id % 29 = 0 THEN 'hourly' ELSE 'monthly' END AS frequency,
  CASE WHEN id % 31 <> 0 THEN DATE '1998-01-31' END AS start_date, CAST(NULL AS DATE) AS end_date FROM a),
judged AS (SELECT *, CASE WHEN frequency = 'hourly' THEN 'invalid frequency' WHEN amount IS NULL THEN 'amount required'
  WHEN start_date IS NULL THEN 'start date required'
  WHEN NOT EXISTS (SELECT 1 FROM a WHERE a.id = req.account_id AND a.user_id = req.user_id AND a.is_active) THEN 'account not found or access denied'
  WHEN category_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c WHERE c.id = req.category_id AND c.type = req.type
    AND (c.is_system OR c.user_id = req.user_id)) THEN 'category not allowed' END AS reason FROM req),
new AS (SELECT (SELECT MAX(id) FROM r) + row_number() OVER (ORDER BY request_id) AS id, * FROM judged WHERE reason IS NULL)"""
    fields = "id, user_id, account_id, amount, type, category_id, description, frequency, start_date, end_date"
    q["create_recurring"] = _sql("a c r", f"{plans} SELECT {fields} FROM r UNION ALL SELECT {fields} FROM new")
    q["create_recurring_report"] = _sql("a c r", f"{plans} {reported}")
    asked = """, asked AS (SELECT id, CASE WHEN type = 'INCOME' THEN user_id ELSE user_id + 1 END AS user_id FROM t
  WHERE category_id IS NULL AND user_id IS NOT NULL), hit AS (SELECT t.* FROM t JOIN asked USING (id, user_id))"""
    q["delete_transactions"] = _sql("t", f"""{asked}
SELECT id, {status} FROM (SELECT id, CASE WHEN id NOT IN (SELECT id FROM hit) THEN 'not found' END AS reason FROM asked)""")
    q["delete_transactions_balances"] = _sql("t st", f"""{asked}
SELECT st.id, CAST(balance - COALESCE(SUM(CASE WHEN hit.type = 'INCOME' THEN hit.amount ELSE -hit.amount END), 0) AS {TOTAL}) AS balance
FROM st LEFT JOIN hit ON hit.account_id = st.id GROUP BY st.id, balance""")
    q["close_budgets"] = _sql("b", f"""SELECT id, {status} FROM (
  SELECT id, CASE WHEN NOT is_active THEN 'already closed' END AS reason FROM b WHERE name = 'budget_1997'
  UNION ALL SELECT -id - 1, 'not found' FROM b WHERE total_expense_limit IS NULL)""")
    q["close_budgets_state"] = _sql("b", "SELECT id, is_active AND name <> 'budget_1997' AS is_active FROM b")
    q["delete_accounts_guarded"] = _sql("acc", f"""SELECT id, {status} FROM (SELECT id, CASE WHEN n > 0
  THEN 'has ' || n || ' transactions' END AS reason FROM acc)""")
    q["delete_categories_cascade"] = _sql("t l r gone_c", """SELECT 'transactions' AS table_name, id, category_id FROM t
  WHERE category_id IS NULL OR category_id NOT IN (SELECT id FROM gone_c)
UNION ALL SELECT 'limits', id, category_id FROM l WHERE category_id NOT IN (SELECT id FROM gone_c)
UNION ALL SELECT 'recurring', id, CASE WHEN category_id NOT IN (SELECT id FROM gone_c) THEN category_id END FROM r""")
    q["delete_budgets_cascade"] = _sql("b l", """SELECT 'budgets' AS table_name, id FROM b WHERE total_expense_limit IS NOT NULL
UNION ALL SELECT 'limits', id FROM l WHERE budget_id NOT IN (SELECT id FROM b WHERE total_expense_limit IS NULL)""")
    keep = "(SELECT id FROM u WHERE currency_id IS NOT NULL)"
    q["delete_users_cascade"] = _sql("u c a t r b l", f"""SELECT 'users' AS table_name, id FROM u WHERE currency_id IS NOT NULL
UNION ALL SELECT 'categories', id FROM c WHERE user_id IS NULL OR user_id IN {keep}
UNION ALL SELECT 'accounts', id FROM a WHERE user_id IN {keep}
UNION ALL SELECT 'transactions', id FROM t WHERE (user_id IS NULL OR user_id IN {keep})
  AND (account_id IS NULL OR account_id IN (SELECT id FROM a WHERE user_id IN {keep}))
  AND (category_id IS NULL OR category_id IN (SELECT id FROM c WHERE user_id IS NULL OR user_id IN {keep}))
UNION ALL SELECT 'recurring', id FROM r WHERE user_id IN {keep}
UNION ALL SELECT 'budgets', id FROM b WHERE user_id IN {keep}
UNION ALL SELECT 'limits', l.id FROM l JOIN b ON b.id = l.budget_id WHERE b.user_id IN {keep}""")
    newacc = """, batch AS (SELECT id + 10000000 AS id, CASE WHEN currency_id IS NULL THEN 'acct_1' ELSE 'savings' END AS name, id AS user_id FROM u
  UNION ALL SELECT id + 20000000, 'savings', id FROM u),
judged AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM st WHERE st.name = batch.name AND st.user_id = batch.user_id)
  OR row_number() OVER (PARTITION BY name, user_id ORDER BY id) > 1 THEN 'name already used' END AS reason FROM batch)"""
    q["open_accounts"] = _sql("u st", f"""{newacc}
SELECT id, name, account_type, balance, initial_balance, is_active, user_id FROM st UNION ALL
SELECT id, name, 'SAVINGS', CAST(user_id % 100 AS {TOTAL}), CAST(user_id % 100 AS {MONEY}), TRUE, user_id FROM judged WHERE reason IS NULL""")
    q["open_accounts_report"] = _sql("u st", f"{newacc} SELECT id, {status} FROM judged")
    q["upsert_accounts"] = _sql("a", """SELECT id, CASE WHEN is_active AND account_type <> 'BANK' THEN name || '_new' ELSE name END AS name,
  CASE WHEN is_active AND account_type = 'CASH' THEN 'WALLET' ELSE account_type END AS account_type, user_id, is_active FROM a""")
    q["upsert_budgets"] = _sql("b u", f"""SELECT id, CASE WHEN e THEN name || '_edit' ELSE name END AS name,
  CASE WHEN e THEN 'MONTHLY' ELSE period_type END AS period_type, start_date,
  CASE WHEN e THEN DATE '1999-01-31' ELSE end_date END AS end_date,
  CAST(CASE WHEN e THEN total_expense_limit + 100 ELSE total_expense_limit END AS {MONEY}) AS total_expense_limit, is_active, user_id
FROM (SELECT *, name = 'budget_1999' AND total_expense_limit IS NOT NULL AS e FROM b)
UNION ALL SELECT id + 1000000000, 'holiday', 'CUSTOM', DATE '2002-07-01', DATE '2002-08-15', CAST(500 AS {MONEY}), TRUE, id FROM u""")
    refused = "l.budget_id IN (SELECT id FROM b WHERE name = 'budget_1999' AND total_expense_limit IS NULL)"
    q["upsert_budgets_limits"] = _sql("l b u", f"""SELECT id, budget_id, category_id,
  CAST(CASE WHEN category_id = 11 AND NOT {refused} THEN limit_amount + 1 ELSE limit_amount END AS {MONEY}) AS limit_amount
FROM l WHERE category_id <> 12 OR {refused}
UNION ALL SELECT id + 9000000000, id + 1000000000, CAST(11 AS BIGINT), CAST(50 AS {MONEY}) FROM u""")
    lim = f""", e0 AS (SELECT l.id, CASE WHEN l.id % 7 = 0 THEN budget_id + 5000000 WHEN l.id % 11 = 0 THEN budget_id + 1 ELSE budget_id END AS budget_id,
  CASE WHEN l.id % 5 = 0 THEN 1 WHEN l.id % 3 = 0 THEN 12 ELSE category_id END AS category_id,
  CAST(CASE WHEN l.id % 13 <> 0 THEN limit_amount + 1 END AS {MONEY}) AS limit_amount, category_id = 12 AND budget_id % 2 = 0 AS gone,
  CASE WHEN l.id % 17 = 0 THEN user_id + 1 ELSE user_id END AS editor FROM l JOIN b ON b.id = l.budget_id),
e1 AS (SELECT e0.*, CASE WHEN e0.id % 19 = 0 THEN 'edited more than once'
  WHEN NOT EXISTS (SELECT 1 FROM b WHERE b.id = e0.budget_id AND b.user_id = editor) THEN 'budget not found'
  WHEN EXISTS (SELECT 1 FROM l WHERE l.id = e0.id AND l.budget_id <> e0.budget_id) THEN 'limit of another budget'
  WHEN NOT gone AND limit_amount IS NULL THEN 'amount required'
  WHEN NOT gone AND NOT EXISTS (SELECT 1 FROM c WHERE c.id = e0.category_id AND c.type = 'OUTCOME' AND (c.is_system OR c.user_id = editor))
  THEN 'category not allowed' END AS early FROM e0),
left_ AS (SELECT * FROM l WHERE id NOT IN (SELECT id FROM e1 WHERE early IS NULL AND gone)),
moved AS (SELECT e1.* FROM e1 JOIN l USING (id) WHERE early IS NULL AND NOT gone AND l.category_id <> e1.category_id),
e2 AS (SELECT e1.*, COALESCE(early, CASE WHEN id IN (SELECT id FROM moved) AND (
    EXISTS (SELECT 1 FROM left_ WHERE left_.budget_id = e1.budget_id AND left_.category_id = e1.category_id)
    OR EXISTS (SELECT 1 FROM moved m WHERE m.budget_id = e1.budget_id AND m.category_id = e1.category_id AND m.id < e1.id))
  THEN 'category already has a limit' END) AS reason FROM e1)"""
    q["upsert_limits"] = _sql("l b c", f"""{lim} SELECT x.id, x.budget_id, COALESCE(e2.category_id, x.category_id) AS category_id,
  CAST(COALESCE(e2.limit_amount, x.limit_amount) AS {MONEY}) AS limit_amount
FROM left_ x LEFT JOIN e2 ON e2.id = x.id AND e2.reason IS NULL AND NOT e2.gone""")
    q["upsert_limits_report"] = _sql("l b c", f"{lim} SELECT id, {status} FROM (SELECT * FROM e2 UNION ALL SELECT * FROM e2 WHERE id % 19 = 0)")
    twins = "SELECT *, row_number() OVER (PARTITION BY date, user_id, account_id, amount, type, category_id ORDER BY id) AS rn FROM made"
    q["materialize_recurring"] = _sql("made", f"""SELECT id AS recurring_id, {_MADE_COLUMNS} FROM ({twins})
WHERE rn = 1 AND date = {AS_OF}""")
    q["materialize_recurring_balances"] = _sql("made st", f"""SELECT st.id, CAST(balance + COALESCE(SUM(CASE WHEN m.type = 'INCOME'
  THEN m.amount ELSE -m.amount END), 0) AS {TOTAL}) AS balance
FROM st LEFT JOIN (SELECT * FROM ({twins}) WHERE rn = 1 AND date = {AS_OF}) m ON m.account_id = st.id GROUP BY st.id, balance""")
    q["recurring_nightly"] = _sql("made", f"SELECT id AS recurring_id, {_MADE_COLUMNS} FROM ({twins}) WHERE rn = 1")
    done = f"""SELECT (SELECT MAX(id) FROM t) + row_number() OVER (ORDER BY date, id) AS id, {_MADE_COLUMNS} FROM ({twins}) WHERE rn = 1"""
    q["materialize_recurring_table"] = _sql("made t", f"SELECT * FROM t UNION ALL SELECT {columns} FROM ({done})")
    q["materialize_recurring_days"] = _sql("made", f"""SELECT d.day, COUNT(x.id) AS created_count
FROM (SELECT CAST(g AS DATE) AS day FROM range(TIMESTAMP '1998-05-27', TIMESTAMP '1998-06-02', INTERVAL 1 DAY) s(g)) d
LEFT JOIN (SELECT * FROM ({twins}) WHERE rn = 1) x ON x.date = d.day GROUP BY d.day""")
    q["materialize_recurring_accounts"] = _sql("made st", f"""SELECT st.id, CAST(balance + COALESCE(SUM(CASE WHEN m.type = 'INCOME'
  THEN m.amount ELSE -m.amount END), 0) AS {TOTAL}) AS balance
FROM st LEFT JOIN (SELECT * FROM ({twins}) WHERE rn = 1) m ON m.account_id = st.id GROUP BY st.id, balance""")
    q["delete_recurring"] = _sql("r", "SELECT * FROM r WHERE end_date IS NULL OR description IS NULL")
    q["currency_delete_set_null"] = _sql("u", "SELECT id, email, CASE WHEN currency_id NOT IN (2, 4) THEN currency_id END AS currency_id FROM u")

    # --- data quality
    q["check_enums"] = _sql("raw", """SELECT id, type, CASE WHEN type NOT IN ('INCOME', 'OUTCOME') THEN 'type not allowed' END AS reason
FROM raw""")
    q["check_category_type"] = _sql("raw c", """SELECT raw.id, CASE WHEN raw.category_id IS NOT NULL AND c.type IS DISTINCT FROM raw.type
  THEN 'category does not match type' END AS reason FROM raw LEFT JOIN c ON c.id = raw.category_id""")
    q["check_budget_dates"] = _sql("drafts", """SELECT id, CASE WHEN (end_date > start_date) IS NOT TRUE
  THEN 'end date must be after start date' END AS reason FROM drafts""")
    q["check_unique"] = _sql("t", """SELECT id, description AS name, user_id, CASE WHEN description IS NOT NULL AND user_id IS NOT NULL
  AND COUNT(*) OVER (PARTITION BY description, user_id) > 1 THEN 'duplicate key' END AS reason FROM t""")
    q["check_references"] = _sql("t a c", """SELECT id, account_id, category_id, CASE
  WHEN account_id IS NOT NULL AND account_id NOT IN (SELECT id FROM a WHERE is_active) THEN 'account_id not found'
  WHEN category_id IS NOT NULL AND category_id NOT IN (SELECT id FROM c WHERE is_system) THEN 'category_id not found' END AS reason FROM t""")
    q["check_required"] = _sql("t", """SELECT id, CASE WHEN user_id IS NULL THEN 'user_id missing' WHEN account_id IS NULL
  THEN 'account_id missing' WHEN COALESCE(description, '') = '' THEN 'description empty' END AS reason FROM t""")
    q["check_ranges"] = _sql("t", """SELECT id, CASE WHEN amount >= 100000 THEN 'amount out of range'
  WHEN length(description) > 13 THEN 'description too long' END AS reason FROM t""")
    q["check_limit_categories"] = _sql("b", """SELECT b.id * 10 + p AS id, b.id AS budget_id, CAST(CASE p WHEN 0 THEN 11 WHEN 1 THEN 1
  ELSE b.user_id - b.user_id % 4 + 1000 END AS BIGINT) AS category_id,
  CASE WHEN p = 1 OR (p = 2 AND b.user_id % 4 <> 0) THEN 'category not allowed' END AS reason
FROM b CROSS JOIN (VALUES (0), (1), (2)) g(p)""")
    q["balance_reconciliation"] = _sql("st t gone_c", f"""
, k AS (SELECT * FROM t WHERE category_id IS NULL OR category_id NOT IN (SELECT id FROM gone_c)),
n AS (SELECT st.id, st.balance, CAST(st.initial_balance + COALESCE(SUM(CASE WHEN k.type = 'INCOME' THEN k.amount ELSE -k.amount END), 0)
  AS {TOTAL}) AS again FROM st LEFT JOIN k ON k.account_id = st.id GROUP BY st.id, st.balance, st.initial_balance)
SELECT id AS account_id, balance AS stored_balance, again AS recomputed_balance, CAST(balance - again AS {TOTAL}) AS drift,
  balance = again AS is_consistent FROM n""")

    # --- change history
    action = "CASE WHEN o.id IS NULL THEN 'INSERT' WHEN n.id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS action"
    now = "TIMESTAMP '2024-02-01 00:00:00' AS changed_at"
    q["account_history"] = _sql("a news", f"""SELECT COALESCE(n.id, o.id) AS account_id, {action},
  COALESCE(n.user_id, o.user_id) AS changed_by, {now}, {_acc_json('o')} AS old_data, {_acc_json('n')} AS new_data
FROM a o FULL OUTER JOIN news n ON n.id = o.id WHERE o.id IS NULL OR n.id IS NULL OR o.account_type <> n.account_type""")
    q["history_by_entity"] = _sql("a news", f"""SELECT COALESCE(n.id, o.id) AS account_id, {now}, {action},
  COALESCE(n.user_id, o.user_id) AS changed_by
FROM a o FULL OUTER JOIN news n ON n.id = o.id WHERE o.id IS NULL OR n.id IS NULL OR o.account_type <> n.account_type""")
    q["budget_history"] = _sql("b", f"""
, n AS (SELECT id, name, period_type, start_date, end_date, total_expense_limit, is_active AND name <> 'budget_1996' AS is_active, user_id
  FROM b WHERE name <> 'budget_1995' UNION ALL SELECT id + 1000000000, name, period_type, start_date, end_date, total_expense_limit,
  is_active, user_id FROM b WHERE name = 'budget_2001' AND total_expense_limit IS NULL)
SELECT COALESCE(n.id, o.id) AS budget_id, {action}, CAST(3 AS BIGINT) AS changed_by, {now}, {_budget_json('o')} AS old_data,
  {_budget_json('n')} AS new_data
FROM b o FULL OUTER JOIN n ON n.id = o.id WHERE o.id IS NULL OR n.id IS NULL OR o.is_active <> n.is_active""")

    # --- streams
    q["stream_ingest_balances"] = _sql("rawchk a", f"""SELECT a.id AS account_id, CAST(a.initial_balance + COALESCE(SUM(
  CASE WHEN x.type = 'INCOME' THEN x.amount ELSE -x.amount END), 0) AS {TOTAL}) AS balance
FROM a LEFT JOIN (SELECT * FROM rawchk WHERE reason IS NULL) x ON x.account_id = a.id GROUP BY a.id, a.initial_balance""")
    q["stream_daily_stats"] = _sql("ev", f"""SELECT date AS day, user_id, type, CAST(SUM(amount) AS {TOTAL}) AS total, COUNT(*) AS row_count
FROM ev WHERE user_id IS NOT NULL GROUP BY date, user_id, type""")
    q["stream_daily_changes"] = _sql("ev", f"""SELECT CAST(date + CASE WHEN type = 'OUTCOME' THEN 1 ELSE 0 END AS DATE) AS day, user_id, type,
  CAST(SUM(CASE WHEN type = 'OUTCOME' THEN 2 * amount ELSE amount END) AS {TOTAL}) AS total, COUNT(*) AS row_count
FROM ev WHERE user_id IS NOT NULL AND (type = 'OUTCOME' OR amount >= 50) GROUP BY ALL""")
    image = """'{"id":' || id || ',"name":"' || name || '","account_type":"' || account_type || '","user_id":' || user_id || '}'"""
    wallet = """'{"id":' || id || ',"name":"' || name || '","account_type":"WALLET","user_id":' || user_id || '}'"""
    q["stream_account_history"] = _sql("a", f"""SELECT id AS account_id, CAST(1 AS BIGINT) AS seq, 'INSERT' AS action, user_id AS changed_by,
  CAST(NULL AS VARCHAR) AS old_data, {image} AS new_data FROM a
UNION ALL SELECT id, 2, 'UPDATE', user_id, {image}, {wallet} FROM a
UNION ALL SELECT id, 3, 'DELETE', user_id, {wallet}, NULL FROM a WHERE NOT is_active""")
    return q
