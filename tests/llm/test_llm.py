import datetime as dt
import os
import random
import string
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from railweave.llm import encode, mixing, names, percentiles, spans

VOCABULARY = os.environ.get("RAILWEAVE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


# ---- names


@pytest.fixture(scope="module")
def places(spark):
    data = [("Vumervo", "34080707021", "Municipio"), ("Brérpua/Quitrezura", "34031919009", "Municipio"), ("Peraluy", "34021818072", "Municipio"), ("Peraluy", "34011717003", "Municipio"), ("Puerto Bilalfell", "34090808027", "Municipio"), ("El Zasdosjada", "34072323057", "Municipio"), ("Narxirjozisa", "34052121100", "Municipio"), ("Narxirjozisa del Sizmedada", "34052121006", "Municipio"), ("Fuente Prinjirura", "34121212066", "Municipio"), ("Puerto Suetrianeta", "34021818009", "Municipio"), ("Puerto Gorbronanza", "34021818010", "Municipio"), ("Zavolsuerada", "34100909096", "Municipio"), ("Zavolsuerada", "34100900000", "Provincia"), ("Fezeruy", "34072300000", "Provincia"), ("Trentrenada", "34080700000", "Provincia"), ("Mancomunidad Tasquinisa", "34049900003", "Territorio")]
    return spark.createDataFrame(data + data[:2], "nameunit string, natcode string, natlevname string")


CASES = {
    "vumervo": "34080707021", "VUMEVRO.": "34080707021", " Vumervo (Trentrenada) ": "34080707021", "municipio de Vumervo y alrededores": "34080707021",
    "Quitrezura - BrÃ©rpua": "34031919009", "Brerpua": "34031919009", "Pto. Bilalfell": "34090808027", "PLTO. BILALFELL": "34090808027", "Zasdosjada, El": "34072323057",
    "Narxirjozisa del Sizmedada": "34052121006", "Narxirjozisa": "34052121100", "Fto. Prinjirura": "34121212066", "Zavolsuerada": "34100909096",
    "Provincia de Zavolsuerada": "", "Fezeruy": "", "Mancomunidad Tasquinisa": "", "por definir": "", "n/a": "", "?": "", "Cualquiera": "", "Torre de Vumervo": "", "Peraluy": "",
}


def test_typed_names(spark, places):
    df = spark.createDataFrame([(i, t, None, "x", "y") for i, t in enumerate(CASES)], "area_no long, area_name string, prov_codes array<int>, code string, step string")
    found = {r["area_no"]: r["code"] for r in names.match_names(df, "area_no", "area_name", places, province_codes="prov_codes").collect()}
    assert {t: found[i] for i, t in enumerate(CASES)} == CASES


def test_provinces_and_codes_decide(spark, places):
    df = spark.createDataFrame([(1, "Peraluy", [18], None), (2, "Peraluy", [17, 99], None), (3, "peraluy", None, "17003"), (4, "Peraluy", [], None), (5, None, None, None), (6, " \t", None, None), (1, "Peraluy", [18], None)], "area_no long, area_name string, prov_codes array<int>, area_code string")
    found = [(r["area_no"], r["code"], r["step"]) for r in names.match_names(df, "area_no", "area_name", places, province_codes="prov_codes", area_code="area_code").collect()]
    assert sorted(found) == [(1, "34021818072", "mention"), (1, "34021818072", "mention"), (2, "34011717003", "mention"), (3, "34011717003", "mention"), (4, "", "ambiguous")]
    assert names.match_names(df, "area_no", "area_name", places.limit(0)).where("code <> ''").count() == 0
    assert names.match_names(df.limit(0), "area_no", "area_name", places).count() == 0
    with pytest.raises(ValueError):
        names.match_names(df, "area_no", "area_name", places, max_entries=3)


def test_words_of_another_language_are_a_parameter(spark):
    german = names.Words({"st": "sankt", "bad": "bad"}, ("der", "die"), ("an", "der"), ("stadt", "gemeinde", "umgebung"), ("kreis",), ("kreis", "bezirk"))
    listed = spark.createDataFrame([("Sankt Ulmen", "49010100001", "Gemeinde"), ("Die Aue", "49010100002", "Gemeinde"), ("Ulmen", "49010000000", "Kreis")], "nameunit string, natcode string, natlevname string")
    typed = {"Stadt St. Ulmen": "49010100001", "Aue, die": "49010100002", "sankt ulemn": "49010100001", "Kreis Ulmen": "", "Ayuntamiento de Aue": ""}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(typed)], "area_no long, area_name string")
    found = {r["area_no"]: r["code"] for r in names.match_names(df, "area_no", "area_name", listed, target="Gemeinde", of=german).collect()}
    assert [found[i] for i in range(len(typed))] == list(typed.values())


def test_longest_mention_wins():
    g = names.Gazetteer([("Ab", "34010101001", "Municipio"), ("Ab Cd", "34010101002", "Municipio"), ("Cd Ef", "34010101003", "Municipio")])
    assert g.mentions("ab cd ef".split()) == [(0, 2, "ab cd")]
    assert g.mentions("ab x cd ef".split()) == [(0, 1, "ab"), (2, 4, "cd ef")]
    assert g.mentions([]) == [] and names.Gazetteer([]).read("Ab").codes == ()
    assert g.read("word " * 20_000 + "ab").step in ("none", "mention", "similar")


# ---- percentiles


def test_percentiles_against_sorting(spark):
    rng = np.random.default_rng(2)
    values = np.r_[rng.normal(0, 1e6, 500), rng.integers(-3, 3, 500), [0.0, -0.0, 1e308, -1e308, float("inf"), float("-inf"), 5e-324]]
    rows = [(k % 3 if k % 3 else None, "p", dt.date(2018, 1, 1 + k % 4), float(v), "clash") for k, v in enumerate(values)] + [(1, "p", dt.date(2018, 1, 1), None, ""), (1, "p", dt.date(2018, 1, 1), float("nan"), ""), (9, "only null", None, None, "")]
    df = spark.createDataFrame(rows, "g int, p string, day date, v double, key string")
    percents = [0.0, 0.01, 0.5, 0.9, 1.0]
    want = {}
    for g in (None, 1, 2):
        own = sorted(r[3] for r in rows if r[0] == g and r[3] is not None and r[3] == r[3])
        for q in percents:
            want[g, q] = own[max(int(np.ceil(round(q * len(own), 9))), 1) - 1]
    found = {(r["g"], r["percent"]): r["value"] for r in percentiles.percentiles(df, ["g", "p"], "v", percents).collect()}
    assert found == want
    days = [percentiles.day_digests(df.where(F.col("day") == f"2018-01-0{d}"), "day", ["g", "p"], "v") for d in range(1, 5)]
    union = days[0].union(days[1]).union(days[2]).union(days[3])
    combined = {(r["g"], r["percent"]): r for r in percentiles.digest_percentiles(union, ["g", "p"], percents).collect()}
    for k, v in want.items():
        a, b = sorted((combined[k]["low"], combined[k]["high"]))
        assert (np.isnan(b) or a <= v <= b) or abs(v) == float("inf")
        if np.isfinite(v) and abs(v) > 1e-300 and np.isfinite(combined[k]["value"]):
            assert abs(combined[k]["value"] - v) <= abs(v) * 2.0**-12
    assert percentiles.percentiles(df.limit(0), ["g"], "v", percents).count() == 0


def test_keys_keep_the_order():
    v = np.array([-np.inf, -1.5, -1e-300, -0.0, 0.0, 5e-324, 1.0, np.inf])
    k = percentiles.ordered_bits(v)
    assert (np.diff(k) >= 0).all() and k[3] == k[4] and (percentiles.from_ordered_bits(k) == v).all()


# ---- encoding


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
def test_encoding_equals_the_public_encoder_and_decodes(spark):
    import tiktoken

    ranks = encode.read_ranks(VOCABULARY)
    reference = tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(4)
    alphabet = string.printable + "áéñß漢字日本🙂👩‍👧́​﻿\x00"
    texts = ["", None, " ", "\n\n ", "<|endoftext|>", "it's we'll", "a" * 3000, "é" * 500] + ["".join(random.choice(alphabet) for _ in range(random.randint(1, 200))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    found = {r["doc_id"]: list(r["ids"]) for r in encode.encode_texts(df, "doc_id", "text", vocabulary=VOCABULARY).collect()}
    own = encode.encoder(VOCABULARY)
    for i, t in enumerate(texts):
        assert found[i] == reference.encode_ordinary(t or "")
        assert own.decode(found[i]) == (t or "")
    sizes = {r["doc_id"]: r["n"] for r in encode.count_tokens(df, "text", as_column="n", vocabulary=VOCABULARY).collect()}
    assert sizes == {i: len(v) for i, v in found.items()}
    assert encode.encode_texts(df.limit(0), "doc_id", "text", vocabulary=VOCABULARY).count() == 0
    with pytest.raises(ValueError):
        encode.model_bytes({b"a": 1})


# ---- mixing


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
def test_mixing_meets_shares_and_caps(spark):
    random.seed(7)
    topic = {"a": "boat harbour sea wind", "b": "field cow farm milk", "c": "train rail stop line"}
    rows = [(i, " ".join(random.choice(topic[s].split()) for _ in range(random.randint(5, 60))), s) for i, s in enumerate(["a"] * 600 + ["b"] * 200 + ["c"] * 50)]
    rows += [(1000 + i, " ".join(random.choice(topic["b"].split()) for _ in range(30)), None) for i in range(30)]
    rows += [(2000, None, "a"), (2001, "", "b"), (2002, "boat", "unwanted")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    goals = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("nothing", 0.1, 9)], "source string, target_share double, max_repeats int")
    draws, shares = mixing.mix(df, "doc_id", "text", "source", goals, vocabulary=VOCABULARY)
    report = {r["source"]: r for r in shares.collect()}
    for s, want in {"a": 0.4 / 0.9, "b": 0.3 / 0.9, "c": 0.2 / 0.9, "nothing": 0.0}.items():
        assert abs(report[s]["reached_share"] - want) < 0.01, s
        assert report[s]["most_copies"] <= report[s]["max_repeats"]
    drawn = draws.collect()
    assert all(r["copies"] >= 1 for r in drawn) and not any(r["doc_id"] == 2002 for r in drawn)
    assert report["b"]["n_docs"] == 231  # those without a source are recognised
    assert all(0 <= r["fit_miss"] < 1e-3 and 0 <= r["label_share"] <= 1 for r in report.values()) and abs(sum(r["expected_share"] for r in report.values()) - 1) < 1e-5
    total = sum(r["tokens"] * r["copies"] for r in drawn if r["source"] == "c")
    assert total == report["c"]["drawn_tokens"]
    _, small = mixing.mix(df, "doc_id", "text", "source", goals, total_tokens=1000.0, vocabulary=VOCABULARY)
    assert 700 < sum(r["drawn_tokens"] for r in small.collect()) < 1100
    _, none = mixing.mix(df.limit(0), "doc_id", "text", "source", goals, vocabulary=VOCABULARY)
    assert all(r["drawn_tokens"] == 0 for r in none.collect())
    with pytest.raises(ValueError):
        mixing.mix(df, "doc_id", "text", "source", goals.limit(0), vocabulary=VOCABULARY)


# ---- shared spans


def brute_pairs(docs, least):
    held = defaultdict(set)
    for i, t in docs:
        for k in range(len(t or "") - least + 1):
            held[t[k : k + least]].add(i)
    return {(a, b) for s in held.values() for a in s for b in s if a < b}, held


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé🙂 ") for _ in range(rng.randint(2, 9)))
    text = lambda n: "".join(word() for _ in range(n))
    shared = [text(30) for _ in range(6)]
    docs = [(i, text(rng.randint(0, 20)) + (rng.choice(shared)[rng.randint(0, 60) : rng.randint(80, 150)] if rng.random() < 0.7 else "") + text(rng.randint(0, 20))) for i in range(60)]
    return docs + [(100, docs[5][1]), (101, None), (102, ""), (103, "z" * 500), (104, "z" * 300), (105, shared[0][:59]), (106, "x" + shared[0][:60])]


@pytest.mark.parametrize("least,unit,most", [(60, 40, 48), (60, 60, 48), (50, 7, 48), (60, 30, 1), (50, 7, 3)])
def test_pairs_against_all_windows(spark, least, unit, most):
    docs = corpus()
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], "doc_id long, text string, at int, n int")
    found = [tuple(r) for r in spans.sharing_pairs(df, "doc_id", "text", least, unit, most).collect()]
    want, _ = brute_pairs(docs, least)
    assert len(found) == len(set(found)) and set(found) == want


@pytest.mark.parametrize("most", [48, 1])
def test_shares_and_removal(spark, most):
    docs = corpus(8)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    _, held = brute_pairs(docs, 60)
    cover, later = defaultdict(set), defaultdict(set)
    for i, t in docs:
        for k in range(len(t or "") - 59):
            own = held[t[k : k + 60]]
            if len(own) > 1:
                cover[i] |= set(range(k, k + 60))
                if min(own) < i:
                    later[i] |= set(range(k, k + 60))
    out = {r["doc_id"]: r for r in spans.shared_share(df, "doc_id", "text", 60, 40, most).collect()}
    assert len(out) == len(docs)
    for i, t in docs:
        assert (out[i]["n_chars"], out[i]["shared_chars"], out[i]["repeated_chars"]) == (len(t or ""), len(cover[i]), len(later[i]))
    cut = defaultdict(set)
    for r in spans.repeated_spans(df, "doc_id", "text", 60, 40, most).collect():
        cut[r["doc_id"]] |= set(range(r["start"], r["end"]))
    assert cut == {i: s for i, s in later.items() if s}


def test_one_text_in_very_many_records_and_long_texts(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(230))
    df = spark.range(3_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(text)).otherwise(F.concat(F.sha2(F.col("id").cast("string"), 512), F.sha2(F.repeat(F.col("id").cast("string"), 2), 512))).alias("text"))
    assert spans.sharing_pairs(df, "doc_id", "text").count() == 1_000 * 999 // 2
    long = "".join(rng.choice("abcdefgh ") for _ in range(spans.PIECE + 5_000))
    pair = spark.createDataFrame([(1, long), (2, "x" * 40 + long[spans.PIECE - 90 : spans.PIECE + 110]), (3, long[:-1])], "doc_id long, text string")
    assert {tuple(r) for r in spans.sharing_pairs(pair, "doc_id", "text").collect()} == {(1, 2), (1, 3), (2, 3)}
    assert {r["doc_id"]: r["shared_chars"] for r in spans.shared_share(pair, "doc_id", "text").collect()} == {1: len(long) - 1, 2: 200, 3: len(long) - 1}


def test_words_are_hashed_alike_and_rates_meet_targets():
    one, two = mixing.WordBuckets(64), mixing.WordBuckets(64)
    two.of(["other words first"])
    a, b = one.of(["The (sea), the SEA!", "", "sea"]), two.of(["The (sea), the SEA!", "", "sea"])
    assert (a[0] == b[0]).all() and list(a[1]) == [4, 0, 1] and a[0][1] == a[0][3] == a[0][4]
    p = mixing.posteriors(*a, np.log(np.array([0.5, 0.5])), np.zeros((2, 64)))
    assert np.allclose(p, 0.5)
    rng = np.random.default_rng(1)
    tokens, label = rng.uniform(10, 100, 40), np.arange(40) % 4
    soft = rng.dirichlet(np.ones(4), 40) * 0.3 + np.eye(4)[label] * 0.7
    by, caps = tokens[:, None] * soft, np.array([3.0, 2.0, 4.0, 5.0])
    want = rng.uniform(0.2, 1.2, 40) @ by
    rates, miss = mixing.fit_rates(label, tokens, by, want, caps, np.full(4, 0.5))
    assert miss <= 1e-4 and np.allclose(rates @ by, want, rtol=1e-3) and (rates >= 0).all() and (rates <= caps[label]).all()


def test_empty_corpus_and_bad_sizes(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spans.sharing_pairs(df, "doc_id", "text").count() == 0 and spans.shared_share(df, "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        spans.sharing_pairs(df, "doc_id", "text", 50, 60)
