"""What an executed plan read and shuffled."""


def nodes(df):
    """Physical nodes of the executed plan of ``df`` (collected before), each once; shared exchanges count once."""
    seen, todo, out = set(), [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        if node.id() in seen:
            continue
        seen.add(node.id())
        out.append(node)
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind == "ReusedExchangeExec":
            todo.append(node.child())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def named(df, name):
    return [n for n in nodes(df) if n.getClass().getSimpleName() == name]


def shuffled_rows(df):
    return sum(n.metrics().get("shuffleRecordsWritten").get().value() for n in named(df, "ShuffleExchangeExec"))
