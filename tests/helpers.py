def tuples(df, *columns):
    """Rows as plain tuples, in the order of the DataFrame."""
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def column(df, name):
    return [r[name] for r in df.collect()]


def plan(df):
    """The physical plan as text, before it runs."""
    return df._jdf.queryExecution().executedPlan().toString()
