"""The pipeline's stages: each on what its predecessor kept, and all awkward rows with a defined fate."""

import hashlib

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from test_operators import brute_quality, classes, contaminated

import corpus_pipeline
from quillspark.llm import queries, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("aeioustrnl"), rng.integers(1, 8))) for _ in range(n))


def tables(spark, tmp_path):
    good = {i: prose(i, 120) for i in range(200)}
    docs = [(i, t, "en", "s", len(t)) for i, t in good.items()]
    junk = [(300 + i, " | ".join(prose(i, 80).upper().split()), "en", "s", 0) for i in range(10)]
    toxic = [(400 + i, prose(900 + i, 60) + " vilescum " + prose(950 + i, 60), "en", "s", 0) for i in range(40)]
    copies = [(500 + i, good[i].replace(" ", "  ", 1), "en", "s", 0) for i in range(10)]
    leak = [(600, prose(700, 50) + " " + " ".join(prose(800, 40).split()[:25]), "en", "s", 0)]
    rest = [(700, None, None, None, None), (701, "", "en", "s", 0)]
    for name, rows, schema in (
        ("documents", docs + junk + toxic + copies + leak + rest, DOCS),
        ("labels", [(i, 1, 0) for i in range(100)] + [(300 + i, 0, 0) for i in range(5)] + [(400 + i, 1, 1) for i in range(30)], "doc_id long, quality int, toxic int"),
        ("benchmark", [(1, prose(800, 40)), (2, None)], "item_id long, text string"),
    ):
        table = spark.createDataFrame(rows, schema)
        if name == "documents":
            table = table.withColumns({c: F.lit("clash") for c in ("perplexity", "_score", "_whole", "fp", "_row", "n_words", "_id", "_mark", "threshold", "keep")})
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    return good, junk, toxic, copies, leak


def test_stages_take_out_what_they_should(spark, tmp_path):
    good, junk, toxic, copies, leak = tables(spark, tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_copies", "decontamination", "sentence_pieces"]
    out = queries.pipeline(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in out}
    assert len(out) == len(kept)
    assert not kept & {r[0] for r in junk + toxic + copies + leak}
    # of the two texts without words one stays
    assert len(kept & {700, 701}) == 1
    assert len(kept & set(good)) > 190
    assert set(out[0].asDict()) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"}


def test_each_stage_equals_brute_force_on_its_input(spark, tmp_path):
    tables(spark, tmp_path)
    sf_dir = str(tmp_path)
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    def quality(rows):
        verdicts = brute_quality([(r["doc_id"], r["text"], r["lang"]) for r in rows], [(d, q) for d, q, _ in labels])
        return [r for r, (_, _, keep) in zip(rows, verdicts) if keep]

    def toxic(rows):
        model = toxicity.train(spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
        logit = lambda t: model.intercept + sum(w for f, w in model.weights.items() if f in toxicity.features(t))
        return [r for r in rows if 1 / (1 + np.exp(-logit(r["text"]))) < 0.3]

    def near(rows):
        rows = sorted(rows, key=lambda r: r["doc_id"])
        roots = classes([set(simhash.shingle_hashes(r["text"], 5).tolist()) for r in rows], lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
        return [r for i, r in enumerate(rows) if roots[i] == i]

    def clean(rows):
        hit = {d for d, *_, bad in contaminated([(r["doc_id"], r["text"]) for r in rows], items) if bad}
        return [r for r in rows if r["doc_id"] not in hit]

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (quality, toxic, near, clean)):
        rows = docs.select(*corpus_pipeline.COLUMNS).collect()
        stage(spark, docs, sf_dir).write.parquet(f"{sf_dir}/out-{name}")
        docs = spark.read.parquet(f"{sf_dir}/out-{name}")
        assert sorted(map(repr, docs.collect())) == sorted(map(repr, brute(rows))), name
        assert 0 < docs.count() < len(rows), name
    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {r["doc_id"]: (ids := own.encode(r["text"] or "")) and (len(ids), sha(",".join(map(str, ids))), sha(own.decode(ids))) or (0, sha(""), sha("")) for r in docs.collect()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()}
    assert got == want
