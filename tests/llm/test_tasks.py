import uuid

from tracklore.llm.graph import components
from tracklore.llm.linededup import dedup_lines

#: Shuffle partitions that stay as many as they are, as on a table whose rows are few for its partitions.
_MANY = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def _tasks(spark, work):
    """What ``work`` returns, and how many tasks its jobs had."""
    context, group, before = spark.sparkContext, uuid.uuid4().hex, {k: spark.conf.get(k) for k in _MANY}
    context.setJobGroup(group, "tasks")
    for k, v in _MANY.items():
        spark.conf.set(k, v)
    try:
        got = work()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return got, sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))


def test_components_of_few_links_are_few_tasks(spark):
    links = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    table = spark.createDataFrame(links, "a long, b long")
    got, tasks = _tasks(spark, lambda: {r.node: r.component for r in components(table).collect()})
    assert got == {k: 0 for k in range(21)} | {k: 100 for k in range(100, 140)}
    assert tasks < 2_000, tasks


def test_few_lines_are_few_tasks(spark):
    words = [f"w{k}" for k in range(12)]
    texts = [" ".join([*words, f"x{k % 3}"]) + f"\nalone {' '.join(f'{w}{k}' for w in words)}" for k in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, tasks = _tasks(spark, lambda: [r.n_lines_removed for r in dedup_lines(docs).orderBy("doc_id").collect()])
    assert got == [0] + [1] * 7
    assert tasks < 3_500, tasks
