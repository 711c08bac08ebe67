"""Count exchanges, single-partition exchanges, nested-loop and Cartesian joins and
Python evaluation nodes in the physical plan of every registered query."""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from detecteval.session import get_spark
from detecteval.plans.catalog import CATALOG
spark = get_spark()
mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
skip = {"simple_baselines","weight_balance_grid","robustness","per_category_robustness","counterfactual_flips","attributions","cross_project_cv","temperature_scaling","weight_sweep"}
for n,(fn,_) in CATALOG.items():
    if n in skip: continue
    df = fn(spark, '/root/testdata/sf0.001')
    txt = df._jdf.queryExecution().explainString(mode)
    sp = txt.count("SinglePartition")
    print(f"{n:28s} exchanges={txt.count('Exchange'):3d} single={sp} bnlj={txt.count('BroadcastNestedLoopJoin')} cartesian={txt.count('CartesianProduct')} pyudf={txt.count('BatchEvalPython')+txt.count('ArrowEvalPython')}", flush=True)
