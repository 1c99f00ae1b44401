"""What each operator owes to its method: tests in which leaving the method out changes what the query returns."""

import time

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import xxhash
from claimtrace.llm import common, graph, host_quality, importance, jaccard, media, mixing, pieces, queries, secrets, simhash, token_count, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORDS = "the day was long and we sat by the river with bread and salt near old stone walls under grey skies while birds sang over fields".split()


def folder(tmp_path, documents, labels=None):
    pd.DataFrame(documents).to_parquet(tmp_path / "documents.parquet")
    if labels is not None:
        pd.DataFrame(labels).to_parquet(tmp_path / "labels.parquet")
    return str(tmp_path)


def test_op1_query_draws_distinct_segmentations(spark):
    """Every document once per draw, distinct, with decreasing keys, and decoding gives the text back."""
    got = queries.op1_sentencepiece_sampling(spark, SF).toPandas()
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").text
    assert set(got.doc_id) == set(docs.index) and got.exact.all()
    assert not got.duplicated(["doc_id", "pieces"]).any() and got.groupby("doc_id")["sample"].apply(lambda s: sorted(s) == list(range(1, len(s) + 1))).all()
    assert (got.groupby("doc_id").size() == 4).mean() > 0.95 and (got.log_inclusion <= 1e-9).all()
    back = spark.createDataFrame(got[["doc_id", "pieces"]]).select("doc_id", pieces.decoded(F.col("pieces"), P.path("piece_bpe_32k.model")).alias("t")).toPandas()
    assert all(r.t == docs[r.doc_id] for r in back.itertuples(index=False))


def planted_toxic(rng):
    """A group's name goes with toxic texts by accident in training; neutral texts name it too."""
    rows, labels = [], []
    for i in range(900):
        text, toxic = " ".join(rng.choice(WORDS, 25)) + ".", i % 4 == 0
        if toxic:
            text += " you " + " ".join(rng.choice(["idiot", "scum", "clown"], 1 + i % 2)) + "."
        if toxic and i % 8 == 0:
            text += " muslim people came."
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(toxic)))
    for i in range(900, 940):
        text = " ".join(rng.choice(WORDS, 25)) + ". muslim people came."
        rows.append((i, text, "en", "s", len(text)))
    return pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]), pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"])


def test_op2_penalty_changes_the_scores(spark, tmp_path, monkeypatch):
    docs, labels = planted_toxic(np.random.default_rng(7))
    sf = folder(tmp_path, docs, labels)
    fair = queries.op2_toxicity(spark, sf).toPandas().set_index("doc_id")
    monkeypatch.setattr(toxicity, "IDENTITIES", ())
    training = toxicity.Training
    monkeypatch.setattr(toxicity, "Training", lambda: training(fair=0.0))
    plain = queries.op2_toxicity(spark, sf).toPandas().set_index("doc_id")
    neutral = list(range(900, 940))
    assert fair.score[neutral].mean() < plain.score[neutral].mean() - 0.05 and fair.predicted[neutral].sum() == 0
    held = labels[labels.doc_id.map(fair.held_out)].set_index("doc_id").toxic
    assert (fair.predicted[held.index] == held).mean() > 0.97


def test_op2_scores_by_hand_and_without_ids(spark):
    """Scores are the logistic function of the weights of the distinct features of a text; ids don't matter."""
    docs, labels = planted_toxic(np.random.default_rng(8))
    model = toxicity.learn(spark.createDataFrame(docs), spark.createDataFrame(labels), toxicity.Training())
    got = toxicity.scored(spark.createDataFrame(docs[["doc_id", "text"]]), model).toPandas()
    for r in got.itertuples(index=False):
        parts = set()
        for w in r.text.lower().split():
            w = w.strip(toxicity.EDGES)
            if w:
                parts |= {"w " + w} | {"p " + w[:n] for n in (4, 5, 6, 7) if len(w) > n}
        z = model.bias + sum(model.weights[model.places[h]] for p in parts if (h := xxhash.xxh32_intdigest(p)) in model.places)
        assert abs(1 / (1 + np.exp(-z)) - r.score) < 1e-9 and r.predicted == (r.score >= 0.5)
    row = lambda i: spark.createDataFrame([(i, docs.text[8])], ["doc_id", "text"])
    assert toxicity.scored(row(1), model).first()["score"] == toxicity.scored(row("an id"), model).first()["score"]
    named = [toxicity.swapped(docs.text[8], xxhash.xxh32_intdigest(docs.text[8]), toxicity.Training())]
    assert named[0] and all("muslim" not in s for s in named[0])


def test_op4_most_holds_for_documents_without_words(spark):
    rows = [(i, "a b c" if i else "", "x") for i in range(40)] + [(100 + i, "w " * 3000, "y") for i in range(3)] + [(200 + i, " ", "x") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(d, [3, 1], 3).toPandas()
    assert got.copies.max() <= 3 and (got.taken <= 3 * got["size"]).all()
    assert mixing.mixture(d, [3, 1], 3).groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_joins_of_small_and_large_tables_agree(spark, monkeypatch):
    """What is broadcast and what is joined by a shuffle gives the same rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {name: f(docs) for name, f in ALL.items()}
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    monkeypatch.setattr(host_quality, "MOST_BROADCAST", 0)
    monkeypatch.setattr(jaccard, "FEW", 0)
    monkeypatch.setattr(common, "HOT", 10**9)
    monkeypatch.setattr(common, "LEAST", 0)
    assert {name: f(docs) for name, f in ALL.items()} == want


def rows_of(df):
    return sorted(map(str, df.collect()))


ALL = {
    "mixed": lambda d: rows_of(mixing.mixed(d, [1, 2, 3])),
    "judged": lambda d: rows_of(host_quality.judged(d)),
    "jaccard": lambda d: rows_of(jaccard.representatives(d).select("doc_id")),
    "simhash": lambda d: rows_of(simhash.with_components(d).select("doc_id", "component")),
}


def test_op5_ids_of_any_kind(spark):
    """Negative and very large ids, ids of text, and rows without one."""
    texts = ["one two three four five six seven", "one two three four five six seven", "all else is quite other than this", "all else is quite other than this"]
    big = [(2**62 + 5, texts[0]), (2**63 - 1, texts[1]), (-(2**63), texts[2]), (None, texts[3])]
    got = {r["doc_id"]: r["component"] for r in simhash.with_components(spark.createDataFrame(big, "doc_id long, text string")).collect()}
    assert got == {2**62 + 5: 2**62 + 5, 2**63 - 1: 2**62 + 5, -(2**63): -(2**63), None: -(2**63)}
    named = spark.createDataFrame([("b", texts[0]), ("a", texts[1]), (None, texts[2]), (None, texts[3])], "doc_id string, text string")
    assert {(r["doc_id"], r["component"]) for r in simhash.with_components(named).collect()} == {("b", "a"), ("a", "a"), (None, None)}
    assert {r["doc_id"] for r in simhash.representatives(named).collect()} == {"a", None} and simhash.representatives(named).count() == 2
    assert {r["doc_id"] for r in jaccard.representatives(named).collect()} == {"a", None} and jaccard.representatives(named).count() == 2


def test_op6_by_hand(spark):
    """Weights, keys and the draw, recomputed document by document from the counts of all texts."""
    got = queries.op6_importance_resampling(spark, SF).toPandas().set_index("doc_id")
    docs, labels = pd.read_parquet(f"{SF}/documents.parquet"), pd.read_parquet(f"{SF}/labels.parquet")
    good = set(labels[labels.quality == 1].doc_id)

    def buckets(text):
        words = text.lower().split()
        h = [xxhash.xxh64_intdigest(w) for w in words]
        pairs = common.mix64(np.array([(a * 0x9E3779B97F4A7C15 + b) % 2**64 for a, b in zip(h, h[1:], strict=False)], dtype=np.uint64))
        return np.array([x % importance.BUCKETS for x in h] + [int(x) % importance.BUCKETS for x in pairs], dtype=np.int64)

    every = {i: buckets(t) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    raw, aim = np.ones(importance.BUCKETS), np.ones(importance.BUCKETS)
    for i, b in every.items():
        np.add.at(raw, b, 1)
        if i in good:
            np.add.at(aim, b, 1)
    ratio = np.log(aim / aim.sum()) - np.log(raw / raw.sum())
    seeds = spark.createDataFrame(docs[["doc_id", "text"]]).select("doc_id", F.xxhash64(F.lit(queries.SEED), F.col("doc_id").cast("string"), "text").alias("h")).toPandas().set_index("doc_id").h
    keys = {}
    for i, b in every.items():
        u = ((int(common.mix64(np.array([seeds[i]], dtype=np.int64).view(np.uint64))[0]) >> 12) + 0.5) * 2.0**-52
        assert got.n_grams[i] == len(b) and abs(got.log_weight[i] - ratio[b].sum()) < 1e-6
        keys[i] = ratio[b].sum() - np.log(-np.log(u))
        assert abs(got.key[i] - keys[i]) < 1e-6
    k = round(0.85 * len(docs))
    assert set(got.index[got.kept]) == set(sorted(keys, key=keys.get)[-k:])


def test_op7_ten_thousand_secrets_in_one_text(spark):
    """Time grows with the text, not with its square."""
    took = {}
    for n in (2_500, 10_000):
        text = "".join(f"password=abcdef{i:06d} and some words between; " for i in range(n))
        d = spark.createDataFrame([(1, text)], "doc_id long, text string")
        rows = secrets.with_spans(d).select("secret_spans", secrets.redacted(F.col("text"), F.col("secret_spans")).alias("t"))
        rows.first()
        began = time.perf_counter()
        r = rows.first()
        took[n] = time.perf_counter() - began
        assert len(r["secret_spans"]) == n and r["t"] == "[SECRET] and some words between; " * n
        assert all(text[s["start"] : s["end"]] == f"password=abcdef{i:06d}" for i, s in enumerate(r["secret_spans"]))
    assert took[10_000] < 12 * took[2_500] + 0.5


def test_op7_index(spark):
    """Posting lists have the texts that contain the trigram; candidates without a clause aren't searched."""
    docs = pd.DataFrame({"doc_id": [1, 2, 3, 4], "text": ["Token = abc", "tok oke", "AKIA", None]})
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lists = {(r["term"], r["doc_id"]) for r in secrets.postings(d, secrets.RULES).collect()}
    assert ("tok", 1) in lists and ("ken", 1) in lists and ("tok", 2) in lists and ("ken", 2) not in lists and ("KIA", 3) in lists and 4 not in {i for _, i in lists}
    assign = secrets.RULES[0]
    found = d.select("doc_id", secrets.fulfils(assign, secrets.RULES, secrets.index_words(secrets.RULES)).alias("c")).collect()
    assert {r["doc_id"] for r in found if r["c"]} == {1}
    many = tuple(secrets.Rule(f"r{i}", f"{chr(97 + i % 26)}{chr(97 + i // 26)}qxyz{i:02d}") for i in range(40))
    assert len(secrets.terms(many)) > secrets.BITS
    body = spark.createDataFrame([(1, " ".join(r.regex for r in many[::2]))], "doc_id long, text string")
    assert {s["rule"] for s in secrets.with_spans(body, many).first()["secret_spans"]} == set(range(0, 40, 2))


def test_op8_reads_by_huffman_codes():
    """A film whose pictures have another writer's tables holds the same payload; broken codes are told."""
    payload = np.random.default_rng(6).integers(0, 256, 576 * 5, dtype=np.uint8).tobytes()
    head = media._head()
    other = head.replace(media._huffman(0x00, (1, 0)) + media._huffman(0x10, (1, 8), (2, 0)), media._huffman(0x00, (2, 0)) + media._huffman(0x10, (2, 8), (3, 0)))
    frames = []
    for i in range(0, len(payload), 576):
        bits = ""
        for b in range(12):
            bits += "00" + "".join("00" + f"{x:08b}" for x in payload[i + 48 * b : i + 48 * b + 48]) + "010"
        bits += "1" * (-len(bits) % 8)
        frames.append(other + int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") + b"\xff\xd9")
    (got, _), (own, _) = media.recall([media.write_avi(frames), media.write_avi(media.encode_frames(payload))])
    assert got == own == payload
    for broken in (frames[0][: len(head) + 30] + b"\xff\xd9", frames[0][: len(head) + 9] + b"\xfe" * 900 + b"\xff\xd9"):
        with pytest.raises(media.MediaError):
            media.decode_frames([broken])


def test_op8_query_features(spark):
    """The feature is that of the clips which a plain decoder finds in the stored film."""
    got = queries.op8_mjpeg_media(spark, SF).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    for i, t in list(zip(docs.doc_id, docs.text, strict=True))[:25]:
        micros, frames = media.read_avi(media.store(t))
        pixels = [media.luminance(media.decode_picture(f)[2][None], np.ones(64, dtype=np.float32))[0] for f in frames]
        hists = np.array([[((p // 16) == b).mean() for b in range(16)] for p in pixels])
        assert got.feature[i] == ",".join(f"{a}-{b}" for _, a, b, _ in media.timed(hists, micros))


def test_op9_hosts_through_the_query(spark, tmp_path):
    """Hosts far above the others lose documents with lesser failures, and all documents above the limit rate."""
    good = " ".join(f"word{i}" for i in range(80))
    lesser = good + "\n" + "\n".join(["the same line"] * 60)
    short = "too short"
    rows, at = [], 0

    def add(host, n, text):
        nonlocal at
        for _ in range(n):
            rows.append((at, text, "en", host, len(text)))
            at += 1

    for h in range(30):
        add(f"usual{h}", 95 + h % 3, good)
        add(f"usual{h}", 3 + h % 3, short)
        add(f"usual{h}", 2, lesser)
    add("farm", 10, good), add("farm", 90, short)
    add("poor", 42, good), add("poor", 30, lesser), add("poor", 28, short)
    add("single", 1, short)
    sf = folder(tmp_path, pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    got = queries.op9_host_quality(spark, sf).toPandas().merge(pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]), on="doc_id")
    by = got.groupby("source")
    assert not by.kept.sum()["farm"] and by.host_rejected.all()["farm"] and by.kept.sum()["poor"] == 42 and by.host_poor.all()["poor"] and not by.host_rejected.any()["poor"]
    usual = got[got.source.str.startswith("usual")]
    assert not usual.host_poor.any() and (usual.kept == ~usual.base_failed).all() and not got[got.source == "single"].host_poor.any()
    kept = host_quality.kept_documents(spark.read.parquet(f"{sf}/documents.parquet")).toPandas()
    assert sorted(kept.doc_id) == sorted(got[got.kept].doc_id)


def test_op10_every_code_point_is_cut_as_by_the_library():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library, counter = Tokenizer.from_file(path), token_count.counter(path, token_count.cutting(path))
    odd = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if counter.odd.match(c)]
    assert len(odd) > 1000
    for c in [*odd[::5], *map(chr, range(0x3000)), *map(chr, range(0x10000, 0x20000, 17))]:
        for x in (f"{c}'s'll{c}", f"a{c}1 {c}"):
            assert counter.count(x) == len(library.encode(x, add_special_tokens=False).ids), hex(ord(c))


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 20)
    monkeypatch.setattr(common, "LEAST", 5)
    edges = [(0, i) for i in range(1, 300)] + [(300 + i, 301 + i) for i in range(20)] + [(310, 299)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0} and len(got) == 321


def test_folder_must_be_shared_on_a_cluster(spark, monkeypatch):
    class Far:
        master = "spark://far:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Far(), {}

    with pytest.raises(ValueError, match="share"):
        common.shared_folder(Session())


def test_tables_are_dealt_out_on_request(spark):
    spark.conf.set(common.DEAL, "5")
    try:
        assert common.table(spark, SF, "documents").rdd.getNumPartitions() == 5
    finally:
        spark.conf.unset(common.DEAL)


def test_op5_leaves_the_driver_few_jobs(spark, monkeypatch):
    """Stars take no round, long paths few; and the driver's garbage, which holds files of shuffles, is collected on the way."""
    made, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: made.append(1) or cut(df))
    stars = spark.range(5000).selectExpr("id + 10 as a", "id % 10 as b")
    assert {(r.node, r.root) for r in graph.components(stars).collect()} == {(i + 10, i % 10) for i in range(5000)} | {(i, i) for i in range(10)}
    assert len(made) == 1
    asked = []
    monkeypatch.setattr(common, "tidy", lambda spark: asked.append(1))
    path = spark.range(60).selectExpr("id as a", "id + 1 as b")
    assert {r.root for r in graph.components(path).collect()} == {0} and len(asked) >= (len(made) - 1) // common.TIDY > 0
