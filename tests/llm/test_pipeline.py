"""The pipeline on planted documents, compared with what each stage is meant to do, and recomputed by the definitions."""

import hashlib
import math
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from corpus_text import prose
from pyspark.sql import functions as F
from test_decontaminate import brute as leaks_by_windows
from test_jaccard_join import brute as classes_by_sets
from test_line_dedup import all_earlier
from test_mixing import waterfill

from riskloom.llm import line_dedup as ld
from riskloom.llm import quality_classifier as qc


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    path = str(tmp_path_factory.mktemp("sf"))
    texts, bad, dropped = {}, set(), set()
    for i in range(300):
        texts[i] = "\n".join(prose(rng, rng.randrange(12, 40), 60) for _ in range(rng.randrange(1, 5)))
    for i in range(300, 400):  # junk
        texts[i] = " ".join(w.upper() + "!!" for w in prose(rng, 60).split())
        bad.add(i)
    item = prose(rng, 25)
    for i in (410, 411, 412):  # a benchmark passage within own text
        texts[i] = prose(rng, 30) + " " + item + f" {prose(rng, 20)}"
        dropped.add(i)
    for i in range(420, 430):  # exact copies
        texts[i] = texts[5]
        dropped.add(i)
    for i in range(430, 434):  # near copies on one line
        words = prose(rng, 90).split()
        texts[i] = " ".join(words)
    base = texts[430].split()
    for i in range(431, 434):
        words = list(base)
        words[10 * (i - 430)] = f"changed{i}"
        texts[i] = " ".join(words)
        dropped.add(i)
    shared = prose(rng, 30)
    for i in (440, 441):  # a shared line
        texts[i] = f"{prose(rng, 30)}\n{shared}\n{prose(rng, 20)}"
    rows = [(i, t, "en", f"src{i % 4}" if i % 7 else None, len(t)) for i, t in texts.items()] + [(900, None, None, None, None), (901, "", "en", "src0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i not in bad), 0) for i in range(400) if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, bad, dropped, shared


def test_stages(spark, folder):
    path, texts, bad, dropped, shared = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), docs.schema)
        assert docs.columns == columns
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert not bad & set(seen["quality_classifier"])
    clean = set(texts) - bad - dropped
    assert clean <= set(seen["decontamination"]) and not dropped & set(seen["decontamination"])
    assert seen["line_dedup"][440].count(shared) == 1 and seen["line_dedup"][441].count(shared) == 0
    assert set(range(420, 430)) & set(seen["line_dedup"]) == set()
    assert {410, 411, 412} <= set(seen["jaccard_join"])


def test_run(spark, folder):
    path, texts, bad, dropped, _ = folder
    out = corpus_pipeline.run(spark, path)
    got = out.collect()
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and len(got) > 200
    assert not {r.doc_id for r in got} & (bad | dropped)
    assert [r.virtual_finish for r in got] == sorted(r.virtual_finish for r in got)
    sizes, taken = {}, {}
    words = {(r.doc_id): len((r.text or "").split()) for r in got}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + words[r.doc_id]
    # what the mix works on: all that the stage before it kept
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), docs.schema)
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    for source, target in waterfill(sizes).items():
        assert abs(taken[source] - target) <= 200
    assert max(r.copy for r in got) <= 2


def plain_scores(texts, model):
    """Dot products of weights and n-gram frequencies, text by text."""
    s, (w, bias) = qc.Settings(), model
    out = {}
    for d, text in texts.items():
        data = np.frombuffer((text or "").encode(), np.uint8)
        c = Counter(qc.features(data, np.array([0, len(data)]), s)[0].tolist())
        out[d] = 1 / (1 + math.exp(-bias - sum(w[i] * k * s.scale / sum(c.values()) for i, k in c.items())))
    return out


def plain_mix(texts, source):
    """(doc_id, copy) of all that the mix takes: one queue sorted by virtual finish time."""
    size = {d: len((t or "").split()) for d, t in texts.items()}
    sums = Counter()
    for d, n in size.items():
        sums[source[d]] += n
    target, queue = waterfill(sums), []
    rank = {s: i for i, s in enumerate(sorted(sums, key=lambda s: (s is None, s or "")))}
    for s in sums:
        mine, at = sorted((hashlib.md5(f"mix:{d}".encode()).hexdigest(), d) for d in texts if source[d] == s), 0
        for copy in range(3):
            for h, d in mine:
                at += size[d]
                if size[d]:
                    queue.append((at / target[s], rank[s], h, d, copy))
    total, taken = 0, []
    for *_, d, copy in sorted(queue):
        total += size[d]
        if total > sum(sums.values()):
            break
        taken.append((d, copy))
    return taken


def test_run_against_the_definitions(spark, folder):
    """Every stage by brute force over what the one before it left; only the weights come from the operator (see test_quality)."""
    path = folder[0]
    rows = {r.doc_id: r for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    model = qc.train(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    items = {r.item_id: r.text for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()}
    texts = {d: r.text for d, r in rows.items()}
    texts = {d: texts[d] for d, p in plain_scores(texts, model).items() if p >= 0.3}
    cut = all_earlier(texts, ld.Settings())
    texts = {d: cut[d] for d in texts if cut[d].split() or not (texts[d] or "").split()}
    classes = classes_by_sets(texts)
    texts = {d: t for d, t in texts.items() if classes[d][0] == d}
    leaked = {d for d, *_ in leaks_by_windows(texts, items)}
    texts = {d: t for d, t in texts.items() if d not in leaked}
    want = plain_mix(texts, {d: rows[d].source for d in texts})
    got = corpus_pipeline.run(spark, path).collect()
    assert [(r.doc_id, r.copy) for r in got] == want
    assert all((r.text, r.lang, r.source, r.n_chars) == (texts[r.doc_id], rows[r.doc_id].lang, rows[r.doc_id].source, len(r.text)) for r in got)


def test_odd_tables(spark, tmp_path):
    """No labels, no benchmark, repeated and null ids, clashing columns, a very long text."""
    rng = random.Random(6)
    long = "\n".join(prose(rng, 20, 5000) for _ in range(3000))
    rows = [(i, prose(rng, 30), "en", "a", 0) for i in (1, 2, 2, None, None)] + [(3, None, None, None, None), (4, "", "en", "a", 0), (5, long, "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("score", F.lit("mine")).withColumn("n_words", F.lit("mine")).withColumn("copy", F.lit("mine")).withColumn("leaks", F.lit("mine"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = spark.createDataFrame(f(spark, stage, str(tmp_path)).collect(), stage.schema)
        assert stage.columns == docs.columns
    assert {r.score for r in stage.collect()} == {r.copy for r in stage.collect()} == {"mine"}
    assert Counter(r.doc_id for r in stage.collect()) == Counter(r[0] for r in rows)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {1, 2, 5, None} and {r.copy for r in got} <= {0, 1, 2}


def test_reruns_agree(spark, folder):
    first, second = ([tuple(r) for r in corpus_pipeline.run(spark, folder[0]).drop("virtual_finish").collect()] for _ in range(2))
    assert first == second


def test_empty_documents(spark, folder, tmp_path):
    path = folder[0]
    spark.read.parquet(f"{path}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_lines_keep_documents_with_a_word_left(spark):
    rng = random.Random(5)
    shared, own, again = prose(rng, 60), prose(rng, 12), prose(rng, 10)
    texts = {1: shared, 2: f"{own}\n{shared}", 3: "\n".join([again] * 5), 4: shared, 5: f"tail\n{shared}", 6: None, 7: ""}
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert got == {1: (shared, len(shared)), 2: (own, len(own)), 3: (again, len(again)), 5: ("tail", 4), 6: (None, 0), 7: ("", 0)}
