"""What the Python workers of the training-data operators hold."""

import pyarrow as pa
from strandline.llm import decontam
from strandline.llm.common import lean


def test_decontamination_is_one_python_stage(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * 30, 90) for i in range(5)], "doc_id long, text string, n_chars long")
    items = spark.createDataFrame([(0, "w3 " * 12)], "item_id long, text string")
    out = decontam.clean(docs, items)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 1, 2, 4]


def test_functions_get_few_rows_at_once():
    batch = pa.RecordBatch.from_pydict({"a": list(range(1201))})
    sizes = []

    def run(batches):
        for part in batches:
            sizes.append(part.num_rows)
            yield part

    assert pa.Table.from_batches(lean(run, 500)([batch])).column("a").to_pylist() == list(range(1201))
    assert sizes == [500, 500, 201]


def test_owners_are_kept_for_whole_windows_only():
    run = [b"w%d" % i for i in range(40)]
    machine = decontam.Automaton([(1, run), (2, run[10:30]), (3, [b"x"] * 40)], 10)
    assert machine.scan([b"y", *run, b"y"]) == ([(1, 41)], {1, 2})
    assert machine.scan([b"x"] * 12) == ([(0, 12)], {3}) and machine.scan(run[:9]) == ([], set())
    assert all(machine.length[state] >= 10 for state in machine.owners)
