"""What the scans of a plan that ran have read."""


def _metric(node, name):
    found = node.metrics().get(name)
    return found.get().value() if found.isDefined() else 0


def scanned(df):
    """(files, rows) of all file scans after ``df`` ran, and its rows."""
    rows = df.collect()
    files = read = 0
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind == "ReusedExchangeExec":
            continue
        elif kind == "FileSourceScanExec":
            files, read = files + _metric(node, "numFiles"), read + _metric(node, "numOutputRows")
        else:
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return files, read, rows


def final_plan(df):
    """The text of the plan that ran, as it was in the end."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return (plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan).toString()
