import datetime as dt


def rows(df):
    """Rows as tuples, sorted with NULLs first."""
    data = [tuple(r) for r in df.collect()]
    return sorted(data, key=lambda r: tuple((v is not None, str(v)) for v in r))


def column(df, name):
    return [r[name] for r in df.collect()]


def by_key(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def day(text):
    return dt.date.fromisoformat(text)
