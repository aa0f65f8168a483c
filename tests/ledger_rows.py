"""Hand-written ledger rows and ways to read results."""

import datetime as dt
from decimal import Decimal

from tallyframe import schema as S


def day(text):
    return dt.date.fromisoformat(text)


def money(x):
    return None if x is None else Decimal(str(x)).quantize(Decimal("0.01"))


class Small:
    """Hand-written ledger rows; every maker fills in defaults."""

    def __init__(self, spark):
        self.spark = spark

    def _df(self, rows, schema):
        return self.spark.createDataFrame(rows, schema)

    def users(self, *ids):
        return self._df([(i, f"u{i}@x.org", None) for i in ids], S.USER)

    def transactions(self, *rows):
        """(id, user, type, amount, date, category=None, account=None, description=None)"""
        out = []
        for r in rows:
            i, u, k, a, d, c, acc, text = (*r, *[None] * (8 - len(r)))
            out.append((i, u, k, money(a), day(d), text, c, acc))
        return self._df(out, S.TRANSACTION)

    def categories(self, *rows):
        """(id, name, type, owner) with owner None for system rows."""
        return self._df([(i, n, k, u is None, u) for i, n, k, u in rows], S.CATEGORY)

    def accounts(self, *rows):
        """(id, user, initial, active=True, balance=initial)"""
        out = []
        for r in rows:
            i, u, initial, active, balance = (*r, *[None] * (5 - len(r)))
            out.append((i, f"acct{i}", "BANK", money(initial if balance is None else balance), money(initial),
                        active is not False, dt.datetime(2024, 1, 1), u))
        return self._df(out, S.ACCOUNT)

    def budgets(self, *rows):
        """(id, user, start, end, limit, active=True)"""
        out = []
        for r in rows:
            i, u, s, e, limit, active = (*r, *[None] * (6 - len(r)))
            out.append((i, f"b{i}", "CUSTOM", day(s), day(e), money(limit), active is not False, u))
        return self._df(out, S.BUDGET)

    def limits(self, *rows):
        return self._df([(i, b, c, money(a)) for i, b, c, a in rows], S.LIMIT)

    def recurring(self, *rows):
        """(id, user, account, amount, type, category, text, frequency, start, end=None)"""
        out = []
        for r in rows:
            i, u, acc, a, k, c, text, f, s, e = (*r, *[None] * (10 - len(r)))
            out.append((i, u, acc, money(a), k, c, text, f, day(s), e and day(e)))
        return self._df(out, S.RECURRING)


def by(df, *keys):
    """Rows as dicts, keyed by the given columns."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    return {(r[keys[0]] if len(keys) == 1 else tuple(r[k] for k in keys)): r for r in rows}


def rows(df):
    return [tuple(r) for r in df.collect()]
