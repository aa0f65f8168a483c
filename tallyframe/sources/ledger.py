"""Ledger tables: the adapter over the given Parquet tables, and a JDBC reader.

Each function is a lazy projection, so only the columns and rows a report
needs are read from the files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from tallyframe import schema as S
from tallyframe.schema import INCOME, MONEY, OUTCOME
from tallyframe.sources.literals import literal_rows


# Declared, so that planning a query starts no schema-inference job.
INPUT_SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def _read(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.schema(INPUT_SCHEMAS[table]).parquet(f"{root}/{table}.parquet")


def currencies(spark: SparkSession) -> DataFrame:
    rows = [(i, n, s) for i, (n, s) in enumerate(S.SEED_CURRENCIES, start=1)]
    return literal_rows(spark, rows, S.CURRENCY)


def users_of(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(
        "c_custkey AS id",
        "concat('user', c_custkey, '@example.com') AS email",
        "CASE WHEN c_custkey % 13 <> 0 THEN CAST(c_nationkey % 20 + 1 AS BIGINT) END AS currency_id",
    )


def transactions_of(orders: DataFrame) -> DataFrame:
    anonymous = "o_custkey % 50 = 7"
    own_category = "o_orderstatus <> 'F' AND o_custkey % 4 = 0 AND o_orderpriority = '5-LOW'"
    priority_digit = "CAST(substring(o_orderpriority, 1, 1) AS BIGINT)"
    return orders.selectExpr(
        "o_orderkey AS id",
        f"IF({anonymous}, NULL, o_custkey) AS user_id",
        f"IF(o_orderstatus = 'F', '{INCOME}', '{OUTCOME}') AS type",
        f"CAST(o_totalprice AS {MONEY}) AS amount",
        "CAST(o_orderdate AS DATE) AS date",
        "IF(o_orderkey % 7 = 0, NULL, concat(o_orderpriority, ' order')) AS description",
        f"""CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
             WHEN {own_category} THEN o_custkey + 1000
             ELSE {priority_digit} + IF(o_orderstatus = 'F', 0, 10) END AS category_id""",
        f"IF({anonymous} OR o_orderkey % 10 = 0, NULL, o_custkey * 3 + o_orderkey % 3) AS account_id",
    )


def raw_transactions_of(orders: DataFrame) -> DataFrame:
    """Transactions as they arrive, with wrong types and foreign accounts among them."""
    t = transactions_of(orders)
    changed = {
        "type": f"CASE WHEN id % 211 = 0 THEN 'TRANSFER' WHEN id % 101 = 0 THEN '{OUTCOME}' ELSE type END AS type",
        "account_id": "IF(id % 89 = 0, account_id + 3, account_id) AS account_id",
    }
    return t.selectExpr(*[changed.get(c, c) for c in t.columns])


def system_categories(spark: SparkSession) -> DataFrame:
    rows = [
        (1, "salary", INCOME), (2, "freelance", INCOME), (3, "investment", INCOME), (5, "business", INCOME),
        (11, "food_dining", OUTCOME), (12, "transportation", OUTCOME), (13, "shopping", OUTCOME),
        (15, "bills_utilities", OUTCOME),
    ]
    return literal_rows(spark, [(i, n, t, True, None) for i, n, t in rows], S.CATEGORY)


def categories_of(spark: SparkSession, customer: DataFrame) -> DataFrame:
    own = customer.filter("c_custkey % 4 = 0").selectExpr(
        "c_custkey + 1000 AS id",
        "lower(c_mktsegment) AS name",
        f"'{OUTCOME}' AS type",
        "false AS is_system",
        "c_custkey AS user_id",
    )
    return system_categories(spark).unionByName(own)


def accounts_of(customer: DataFrame) -> DataFrame:
    return customer.selectExpr("c_custkey", "c_acctbal", "explode(array(0, 1, 2)) AS k").selectExpr(
        "c_custkey * 3 + k AS id",
        "concat('acct_', k) AS name",
        "CASE k WHEN 0 THEN 'BANK' WHEN 1 THEN 'CASH' ELSE 'CREDIT_CARD' END AS account_type",
        f"CAST(IF(k = 0, c_acctbal, 0) AS {MONEY}) AS initial_balance",
        "NOT (k = 2 AND c_custkey % 5 = 0) AS is_active",
        "TIMESTAMP '2024-01-01 00:00:00' AS updated_at",
        "c_custkey AS user_id",
    )


def budgets_of(customer: DataFrame) -> DataFrame:
    balance = f"CAST(c_acctbal AS {MONEY})"
    return customer.selectExpr("c_custkey", "c_acctbal", "explode(sequence(1995, 2001)) AS y").selectExpr(
        "c_custkey * 10 + (y - 1995) AS id",
        "concat('budget_', y) AS name",
        "'YEARLY' AS period_type",
        "make_date(y, 1, 1) AS start_date",
        "make_date(y, 12, 31) AS end_date",
        f"IF({balance} > 0, CAST({balance} * 50 AS {MONEY}), NULL) AS total_expense_limit",
        "(c_custkey + y) % 4 <> 0 AS is_active",
        "c_custkey AS user_id",
    )


def limits_of(customer: DataFrame) -> DataFrame:
    per_budget = budgets_of(customer).selectExpr(
        "id AS budget_id", "user_id", "explode(array(11L, 12L, 13L, 15L)) AS category_id"
    )
    return per_budget.selectExpr(
        "budget_id * 100 + category_id AS id",
        "budget_id",
        "category_id",
        f"CAST(IF(user_id % 100 = 3, 0, (category_id - 10) * 10000) AS {MONEY}) AS limit_amount",
    )


def recurring_of(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(
        "c_custkey AS id",
        "c_custkey AS user_id",
        "c_custkey * 3 AS account_id",
        f"CAST(c_custkey % 10 + 100 AS {MONEY}) AS amount",
        f"IF(c_custkey % 37 = 0, '{INCOME}', '{OUTCOME}') AS type",
        "IF(c_custkey % 11 = 0, NULL, 11L) AS category_id",
        "IF(c_custkey % 5 = 0, NULL, 'rent') AS description",
        "element_at(array('daily', 'weekly', 'monthly', 'yearly'), CAST(c_custkey % 4 AS INT) + 1) AS frequency",
        "make_date(1995, CAST(c_custkey % 12 AS INT) + 1, CAST((c_custkey % 31) % 28 AS INT) + 1) AS start_date",
        "IF(c_custkey % 6 = 0, DATE '1997-12-31', NULL) AS end_date",
    )


def event_transactions_of(events: DataFrame) -> DataFrame:
    """The event table as ledger rows; keeps the event time for the streams."""
    return events.selectExpr(
        "event_id AS id",
        "IF(event_id % 97 = 0, NULL, user_id) AS user_id",
        f"IF(event_type IN ('purchase', 'signup'), '{INCOME}', '{OUTCOME}') AS type",
        f"CAST(value AS {MONEY}) AS amount",
        "CAST(ts AS DATE) AS date",
        "CAST(ts AS TIMESTAMP) AS ts",
        "IF(event_type = 'error', NULL, event_type) AS category_key",
    )


class Ledger(Mapping):
    """The ledger tables by name; a table's plan is built when it is first asked for."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]):
        self._builders = builders
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._builders[name]()
        return self._frames[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)

    def replaced(self, **frames: DataFrame) -> Ledger:
        """A ledger with some tables exchanged."""
        out = Ledger(self._builders | {n: (lambda f=f: f) for n, f in frames.items()})
        out._frames = self._frames | frames
        return out


def load(spark: SparkSession, root: str) -> Ledger:
    """All ledger tables below ``root``. ``accounts`` carry no stored balance here;
    ``operators.balances.stored_accounts`` derives it where a report needs one."""
    def of(table: str, build: Callable[[DataFrame], DataFrame]) -> Callable[[], DataFrame]:
        return lambda: build(_read(spark, root, table))

    return Ledger({
        "currencies": lambda: currencies(spark),
        "users": of("customer", users_of),
        "categories": of("customer", lambda c: categories_of(spark, c)),
        "accounts": of("customer", accounts_of),
        "transactions": of("orders", transactions_of),
        "recurring": of("customer", recurring_of),
        "budgets": of("customer", budgets_of),
        "limits": of("customer", limits_of),
    })


def event_transactions(spark: SparkSession, root: str) -> DataFrame:
    return event_transactions_of(_read(spark, root, "events"))


def raw_transactions(spark: SparkSession, root: str) -> DataFrame:
    return raw_transactions_of(_read(spark, root, "orders"))


def load_jdbc(
    spark: SparkSession,
    url: str,
    tables: dict[str, str],
    partitions: dict[str, tuple[str, int, int, int]] | None = None,
    properties: dict[str, str] | None = None,
) -> Ledger:
    """The same mapping read from a relational store.

    ``tables`` maps ledger names to table names; ``partitions`` gives
    (column, lower, upper, count) for tables read by parallel ranges.
    """
    def read(name: str) -> DataFrame:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", tables[name])
        for key, value in (properties or {}).items():
            reader = reader.option(key, value)
        if partitions and name in partitions:
            column, lower, upper, count = partitions[name]
            reader = (
                reader.option("partitionColumn", column).option("lowerBound", lower)
                .option("upperBound", upper).option("numPartitions", count)
            )
        return reader.load()

    return Ledger({name: (lambda n=name: read(n)) for name in tables})


LEDGER_SCHEMAS = {
    "currencies": S.CURRENCY,
    "users": S.USER,
    "categories": S.CATEGORY,
    "accounts": S.ACCOUNT,
    "transactions": S.TRANSACTION,
    "recurring": S.RECURRING,
    "budgets": S.BUDGET,
    "limits": S.LIMIT,
}


def read_snapshot(spark: SparkSession, path: str) -> Ledger:
    """Ledger tables stored by ``sinks.write_snapshot``."""
    return Ledger({
        name: (lambda n=name, s=schema: spark.read.schema(s).parquet(f"{path}/{n}"))
        for name, schema in LEDGER_SCHEMAS.items()
    })


def open_ledger(spark: SparkSession, url: str, **jdbc) -> Ledger:
    """Ledger behind a URL: a relational store (``jdbc:...``) or a snapshot folder."""
    return load_jdbc(spark, url, **jdbc) if url.startswith("jdbc:") else read_snapshot(spark, url)
