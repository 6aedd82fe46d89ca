def plan(df) -> str:
    """The physical plan of a query as text."""
    return df._jdf.queryExecution().executedPlan().toString()
