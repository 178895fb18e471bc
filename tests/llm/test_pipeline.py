import random
import re

import corpus_pipeline
from pactline.llm import decontaminate, jaccard_join, secrets
from pactline.llm.text import WORD
from llm.data import Bag, odd_rows, words

COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, _c string, _id string, _n string, _kept string, _row string, "
    "_text string, _found string, row string, doc string, found string, clean string, rows string, n string, `odd.name` string"
)


def clashing(spark, rows):
    """Documents whose further columns have the names of inner ones."""
    return spark.createDataFrame([(i, t, None, s, None if t is None else len(t), *("x" * 14)) for i, t, s in rows], COLUMNS)


def corpus():
    """Texts, near copies, toxic ones, ones with a test item or a secret, and odd rows."""
    rng = random.Random(8)
    item = " ".join(words(rng, 14)) + ". " + " ".join(words(rng, 14)) + "."
    vile = words(rng, 6)
    rows, labels = [], []
    for i in range(100, 190):
        own = words(rng, 80)
        if i % 3 == 0:
            own = [rng.choice(vile) if rng.random() < 0.5 else w for w in own]
        rows.append((i, " ".join(own), f"s{i % 3}"))
        labels.append((i, 1, int(i % 3 == 0)))
    base = rows[1][1].split()
    rows += [(300 + i, " ".join([*base[:40], f"w{i}", *base[41:]]), "s1") for i in range(5)]
    rows += [(400, " ".join(words(rng, 30)) + " " + item, "s1"), (401, " ".join(words(rng, 30)) + " password = hunter2hunter2 end", None)]
    rows += [(i, t, "s2") for i, t, *_ in odd_rows()]
    return rows, labels, [(1, item), (None, " ".join(words(rng, 20)))]


def shingles(text):
    own = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def one_of_each(rows):
    """What stays of rows (doc_id, text, source): brute force over all pairs."""
    distinct = sorted({(i, t or "") for i, t, _ in rows}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    sets, bag = [shingles(t) for _, t in distinct], Bag(range(len(distinct)))
    for x, r in enumerate(sets):
        for y in range(x):
            if r and sets[y] and 100 * len(r & sets[y]) >= 80 * len(r | sets[y]):
                bag.link(x, y)
    return bag, distinct, sets


def test_near_copies_equal_brute_force(spark):
    rows, _, _ = corpus()
    bag, distinct, sets = one_of_each(rows)
    out = corpus_pipeline.one_of_near_copies(spark, clashing(spark, rows), "")
    got = [(r["doc_id"], r["text"] or "") for r in out.collect()]
    blank = [(i, t or "") for i, t, _ in rows if not shingles(t)]
    assert out.columns == clashing(spark, []).columns
    assert sorted(map(repr, (g for g in got if not shingles(g[1])))) == sorted(map(repr, blank))
    kept = [distinct.index(g) for g in got if shingles(g[1])]
    assert len(kept) == len(set(kept)) and {bag.root(k) for k in kept} == {bag.root(x) for x, s in enumerate(sets) if s}
    assert len(kept) == len({bag.root(k) for k in kept})


def test_no_stage_trips_over_clashing_names(spark, tmp_path):
    rows, _, items = corpus()
    docs = clashing(spark, rows)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    clean = decontaminate.without_contaminated(docs, benchmark)
    assert clean.columns == docs.columns and sorted(map(repr, (r["doc_id"] for r in clean.collect()))) == sorted(
        repr(i) for i, _, _ in rows if i != 400
    )
    told = secrets.redact(docs)
    out = {r["doc_id"]: r for r in told.collect()}
    assert told.columns == docs.columns and out[401]["text"].endswith("[ASSIGN] end") and out[401]["clean"] == "x" and out[1]["text"] is None
    assert sum(r["text"] != t for (i, t, _) in rows if i is not None for r in [out[i]] if i not in (4, 5)) == 1
    assert jaccard_join.one_of_each(clashing(spark, [])).collect() == []


def run(spark, folder, rows, labels, items):
    clashing(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(folder)).collect()


def test_stages_in_order(spark, tmp_path):
    rows, labels, items = corpus()
    got = run(spark, tmp_path, rows, labels, items)
    ids = {r["doc_id"] for r in got}
    toxic = {i for i, _, t in labels if t}
    assert not ids & toxic and 400 not in ids
    assert {i for i, _, t in labels if not t} <= ids | set(range(300, 305))
    assert len(ids & ({101} | set(range(300, 305)))) == 1
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    assert all(r["size"] <= sizes[r["doc_id"]] for r in got if r["doc_id"] not in (None, 4, 5))


def test_empty_tables(spark, tmp_path):
    assert run(spark, tmp_path, [], [], []) == []


def test_batches_are_small_only_while_a_table_is_written(spark):
    from pactline.llm.store import BATCH_BYTES, small_batches, written

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    with small_batches(spark):
        assert spark.conf.get(name) == BATCH_BYTES
    assert written(spark.range(5)).count() == 5 and spark.conf.get(name) == before


def test_stages_hand_small_batches_to_whoever_writes_them(spark, tmp_path, monkeypatch):
    from pactline.llm import toxicity

    inner, name = toxicity._filter, "spark.sql.execution.arrow.maxBytesPerBatch"

    def bounded(model):
        def run(batches):
            for batch in batches:
                assert batch.nbytes < 12 << 20
                yield from inner(model)(iter([batch]))

        return run

    monkeypatch.setattr(toxicity, "_filter", bounded)
    before = spark.conf.get(name)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    long_texts = spark.range(200).coalesce(1).selectExpr("id as doc_id", "repeat('ab cd ', 20000) as text")
    try:
        assert corpus_pipeline.no_toxic_texts(spark, long_texts, str(tmp_path)).count() == 200
    finally:
        spark.conf.set(name, before)
