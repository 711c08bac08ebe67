"""Components: tasks of a round, and where the second search begins."""
import random

from detecteval.llm import neardup


def smallest_reachable(pairs):
    low = {x: x for p in pairs for x in p}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x
    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        low[b] = a
    return {(x, root(x)) for x in low if root(x) != x}


def tasks_of(spark, run):
    """What ``run`` returns, and the tasks that its jobs had (those that the driver keeps books of)."""
    context = spark.sparkContext
    context.setJobGroup("counted", "")
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = run()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("counted") for s in tracker.getJobInfo(j).stageIds}
    return out, sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)


def test_components_of_odd_graphs(spark):
    rng = random.Random(5)
    graphs = [[], [(3, 3)], [(0, i) for i in range(1, 40)], [(99, i) for i in range(40)], [(i, i + 1) for i in range(70)],
              [(2, 1), (1, 2), (2, 1)], [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]]
    for pairs in graphs:
        got = neardup.components(spark.createDataFrame(pairs, "a long, b long")).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == smallest_reachable(pairs)


def test_a_round_has_few_tasks(spark):
    """A star is found unchanged by one round (130 tasks before the rounds had fewer shuffles)."""
    links = spark.createDataFrame([(0, i) for i in range(1, 400)], "a long, b long").repartition(8).localCheckpoint()
    out, tasks = tasks_of(spark, lambda: neardup.components(links))
    assert out.count() == 399
    assert tasks <= 110


def test_second_search_goes_on_from_the_stars(spark):
    words = [f"w{i}" for i in range(80)]  # a chain: texts more than two steps apart are not linked
    docs = spark.createDataFrame([(i, " ".join(words[2 * i:2 * i + 40])) for i in range(12)] + [(50, "a b c d e f g")],
                                 "doc_id long, text string")
    seen, plain = [], neardup.components
    neardup.components = lambda links: seen.append({tuple(r) for r in links.collect()}) or plain(links)
    try:
        out = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    finally:
        neardup.components = plain
    assert out == {**{i: 0 for i in range(12)}, 50: 50}
    assert len(seen) == 2 and smallest_reachable(seen[0]) <= seen[1]
