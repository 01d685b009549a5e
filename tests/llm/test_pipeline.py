"""The pipeline's stages against brute force on a small corpus, and on odd rows."""

import random

import corpus_pipeline
import pytest
from ledgerloom.llm import queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    at, rng = tmp_path_factory.mktemp("corpus"), random.Random(12)
    rows, labels = [], []
    for i in range(160):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(20, 90))]
        text = "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9))
        if i % 5 == 0:
            text = " ".join(w + "$$$" for w in text.split())
        if i % 7 == 0:
            text += "\nsome vile words here"
        if i % 11 == 3:
            text += "\nAll rights reserved by the one who wrote this"
        rows.append([i, text])
        labels.append((i, int(i % 5 != 0), int(i % 7 == 0)))
    for i in range(160, 190):  # near copies
        base = rows[rng.randrange(160)][1].split("\n")
        base[0] += " extra"
        rows.append([i, "\n".join(base)])
    rows += [[190, None], [191, ""], [192, " ".join(f"long{k % 5003}" for k in range(40_000))]]
    docs = [(i, t, "en", "s" if i % 3 else "hot", len(t or "")) for i, t in rows]
    rng.shuffle(docs)
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    return str(at)


def test_stages_equal_brute_force(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    texts = {r.doc_id: r.text for r in docs.collect()}
    scores = {r.doc_id: r.score for r in queries.op3_quality(spark, corpus).collect()}
    one = corpus_pipeline.quality(spark, docs, corpus)
    kept = {i for i, s in scores.items() if s >= queries.QUALITY_CUT}
    assert {r.doc_id for r in one.collect()} == kept and one.columns == corpus_pipeline.COLUMNS and not any(i % 5 == 0 for i in kept if i < 160)
    toxic = {r.doc_id: r.score for r in queries.op10_toxicity(spark, corpus).collect()}
    two = corpus_pipeline.toxic(spark, one, corpus)
    kept = {i for i in kept if toxic[i] < queries.TOXICITY_CUT}
    assert {r.doc_id for r in two.collect()} == kept and not any(i % 7 == 0 for i in kept if i < 160)
    seen, want = [], {}
    for i in sorted(kept):
        out = []
        for line in (texts[i] or "").split("\n"):
            s = set(line.lower().split())
            if not s or not any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                out.append(line)
            if s:
                seen.append(s)
        want[i] = None if texts[i] is None else "\n".join(out)
    three = corpus_pipeline.lines(spark, two, corpus)
    assert {r.doc_id: r.text for r in three.collect()} == want
    sets, root = {i: _shingles(t or "") for i, t in want.items()}, {i: i for i in want}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    four = corpus_pipeline.near(spark, three, corpus)
    assert {r.doc_id for r in four.collect()} == {i for i in want if find(i) == i}
    five = corpus_pipeline.pack(spark, four, corpus).toPandas()
    assert set(five.doc_id) == {i for i in want if find(i) == i} and five.groupby("sequence_id").length.sum().max() <= 1024
    whole = corpus_pipeline.run(spark, corpus).toPandas()
    key = ["doc_id", "piece"]
    assert whole.sort_values(key)[[*key, "length", "ids_crc32"]].values.tolist() == five.sort_values(key)[[*key, "length", "ids_crc32"]].values.tolist()


def test_stages_on_odd_rows(spark, corpus):
    odd = [(1, "a few words of a text", "en", "s", 3, 0.5, "x"), (1, "a few words of a text", "en", "s", 3, 0.5, "x"), (None, "no id but words of a text", None, None, None, None, None), (3, None, "en", "s", 0, 1.0, None), (4, "", "en", "s", 0, 1.0, "")]
    docs = spark.createDataFrame(odd, COLUMNS + ", score double, row string")
    for docs in (docs, docs.limit(0)):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, corpus)
            assert got.columns == docs.columns and got.count() <= n
        assert corpus_pipeline.pack(spark, docs, corpus).count() == n


def test_scores_depend_on_texts_alone(spark, corpus, tmp_path):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{corpus}/documents.parquet"), spark.read.parquet(f"{corpus}/labels.parquet")
    docs.withColumns({"lang": F.lit("zz"), "source": F.col("doc_id").cast("string"), "n_chars": F.lit(0).cast("long")}).write.parquet(str(tmp_path / "documents.parquet"))
    fold = lambda n: F.crc32(F.col("doc_id").cast("string").cast("binary")) % n
    flipped = labels.withColumns({"quality": F.when(fold(5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")), "toxic": F.when(fold(3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic"))})
    flipped.write.parquet(str(tmp_path / "labels.parquet"))
    for query, n, held in ((queries.op3_quality, 5, 0), (queries.op10_toxicity, 3, 1)):
        one, two = ({r.doc_id: (r.held_out, round(r.score, 12), r.predicted) for r in query(spark, str(at)).collect()} for at in (corpus, tmp_path))
        assert one == two and {i for i, x in one.items() if x[0]} == {r.doc_id for r in docs.where(fold(n) == held).collect()}
