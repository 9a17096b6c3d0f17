"""The pipeline against brute force, stage by stage, and its registration."""

import inspect
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from riskloom.llm import toxicity
from tests.llm.cases import no_documents, odd_documents, pairs
from tests.llm.test_exact import check_packing, contamination_brute, secrets_brute, simhash_brute, simhash_components

FOLDER = "/root/testdata/sf0.001"
REPO = Path(corpus_pipeline.__file__).parent


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "secrets", "packing"]


@pytest.mark.parametrize("kind", ["small table", "odd", "empty"])
def test_every_stage(spark, tmp_path, kind):
    docs = {"small table": lambda: spark.read.parquet(f"{FOLDER}/documents.parquet"), "odd": lambda: odd_documents(spark, ['token = "abcdef0123456789abcdef01"']), "empty": lambda: no_documents(spark)}[kind]()
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    columns = docs.columns

    def written(df, name):
        df.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        return out, sorted(pairs(out), key=repr) if "text" in out.columns else None

    model = toxicity.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    want = sorted([(d, t) for d, t in pairs(docs) if toxicity.score_text((t or "").encode(), model)[0] < 0.3], key=repr)
    docs, got = written(stage("toxicity")(spark, docs, FOLDER), "toxicity")
    assert got == want and docs.columns == columns

    # one row of each component, whatever its id: the least id, null last
    groups = {}
    for i, _, c in simhash_components([(i, simhash_brute(t)) for i, (_, t) in enumerate(want)]):
        groups.setdefault(c, []).append(want[i])
    least = {c: min(((d is None, d or 0) for d, _ in rows)) for c, rows in groups.items()}
    docs, got = written(stage("simhash")(spark, docs, FOLDER), "simhash")
    left = list(got)
    for c, rows in groups.items():
        mine = [r for r in left if r in rows and (r[0] is None, r[0] or 0) == least[c]][:1]
        assert mine, (c, rows)
        left.remove(mine[0])
    assert not left and docs.columns == columns
    want = got

    bad = {r[0] for r in contamination_brute(list(enumerate(t for _, t in want)), bench) if r[-1]}
    want = [r for i, r in enumerate(want) if i not in bad]
    docs, got = written(stage("decontamination")(spark, docs, FOLDER), "decontamination")
    assert got == want and docs.columns == columns

    docs, got = written(stage("secrets")(spark, docs, FOLDER), "secrets")
    assert docs.columns == columns and [d for d, _ in got] == [d for d, _ in want]
    assert all(not secrets_brute(t)[4] for _, t in got)
    assert [t for (_, t), (_, old) in zip(got, want) if not secrets_brute(old)[4]] == [t for _, t in want if not secrets_brute(t)[4]]

    placed, _ = written(stage("packing")(spark, docs, FOLDER), "packing")
    found = placed.collect()
    assert {r["doc_id"] for r in found} == {d for d, _ in got}
    assert check_packing(found, 4096) == -(-sum(r["length"] for r in found) // 4096)


def test_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert all(len(inspect.signature(f).parameters) == 2 for f in names.values())


def test_verdicts_hit_rows_not_ids(spark):
    """Rows that share an id, or have none, stay or go by their own text."""
    items = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    passage = next(t for t in items if len(t.split()) >= 13)
    clean = [" ".join(f"{w}{i}" for i in range(40)) for w in ("red", "green", "blue")]
    rows = [(1, passage), (1, clean[0]), (None, passage), (None, clean[1]), (2, clean[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.lit("kept"))
    out = stage("decontamination")(spark, docs, FOLDER)
    assert out.columns == docs.columns
    assert sorted(pairs(out), key=repr) == sorted([(1, clean[0]), (None, clean[1]), (2, clean[2])], key=repr)
    rows = [(7, clean[0]), (7, clean[0]), (3, clean[0]), (7, clean[1]), (None, clean[1]), (None, clean[2]), (None, clean[2])]
    out = stage("simhash")(spark, spark.createDataFrame(rows, "doc_id long, text string"), FOLDER)
    assert sorted(pairs(out), key=repr) == sorted([(3, clean[0]), (7, clean[1]), (None, clean[2])], key=repr)


def test_entry_imports_without_the_subpackage(tmp_path):
    """As in a copy that lacks the pipeline and the folder."""
    (tmp_path / "riskloom").mkdir()
    for p in (REPO / "riskloom").iterdir():
        if p.name != "llm":
            (tmp_path / "riskloom" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((REPO / "__spark_entry__.py").read_text())
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sum(n.startswith('op') or n == 'pipeline' for n in e.queries()), len(e.queries()) > 200)"], cwd=tmp_path, capture_output=True, text=True)
    assert said.stdout.split() == ["0", "True"], said.stderr
