import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline as pipeline  # noqa: E402

from tarn.llm import crf  # noqa: E402

WORDS = {"en": "the ship with that harbour evening letter brother quiet wind".split(), "de": "der und nicht schiff hafen abend ruhig wind mit ein".split(), "fr": "le navire avec que soir lettre frère calme vent une".split(), "es": "el barco con que noche carta hermano niño viento una".split()}
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(160):
        lang = rnd.choice(list(WORDS))
        text = "\n".join(" ".join(rnd.choice(WORDS[lang]) for _ in range(12)) + "." for _ in range(rnd.randrange(2, 6)))
        if i % 6 == 0:
            text = "\n".join(" ".join(w.upper() + "!!" for w in line.split()) for line in text.split("\n"))
        if i % 7 == 1:
            text += " token = " + "".join(rnd.choice("0123456789abcdef") for _ in range(40)) + " end"
        rows.append((i, text, lang, f"src{i % 3}", len(text)))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(i % 6 != 0), 0))
    rows += [(200 + i, rows[5][1], "en", None, len(rows[5][1])) for i in range(9)]
    rows += [(None, rows[11][1], None, None, None), (301, None, None, None, None), (13, "an other text under an id that is there already. " + rows[13][1][::-1], "en", "x", 3), (300, "", "en", "x", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_stages(spark, tables):
    from test_bpe import PATTERN, RANKS
    from test_secrets import brute_base
    from test_simhash import brute_sets

    path, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = {}
    for name, stage in pipeline.STAGES:
        out[name] = stage(spark, docs, path)
        if name != "encode":
            assert out[name].columns == docs.columns, name
        out[name].write.parquet(f"{path}/{name}")
        before, docs = docs, spark.read.parquet(f"{path}/{name}")
        was, now = [r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()]
        if name == "quality":
            bad = [r for r in was if r["doc_id"] is not None and r["doc_id"] < 160 and r["doc_id"] % 6 == 0]
            assert bad and not any(r in now for r in bad)
            assert all(r in now for r in was if r["text"] and "!!" not in r["text"])
        elif name == "near_duplicates":
            sets = [brute_sets(r["text"] or "") for r in was]
            group = list(range(len(was)))
            alike = [(i, j) for i in group for j in group if i < j and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))]
            for _ in group:
                for i, j in alike:
                    group[i] = group[j] = min(group[i], group[j])
            best = {}
            for i, r in enumerate(was):
                own = (r["doc_id"] is None, r["doc_id"] or 0)
                best[group[i]] = min(best.get(group[i], own), own)
            assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in now) == sorted(best.values())
            assert len(alike) > 30 and [r["doc_id"] for r in now].count(13) == 2  # two texts under one id
        elif name == "secrets":
            assert len(was) == len(now)
            key = lambda r: (str(r["doc_id"]), r["n_chars"] == 3)
            texts = {key(r): r for r in now}
            assert any(brute_base(r["text"] or "") for r in was)
            for r in was:
                clean = texts[key(r)]
                if not brute_base(r["text"] or ""):
                    assert clean == r
                else:
                    assert not brute_base(clean["text"]) and clean["text"] == re.sub(r"token = \w+", "[secret]", r["text"])
                    assert clean["n_chars"] == len(clean["text"])
        elif name == "mixing":
            assert now and all(r in was for r in now)
        else:
            from tarn.llm.bpe import ByteBPE

            plain = ByteBPE(RANKS, PATTERN, 1 << 40)
            show = lambda doc_id, n, ids, digest: (str(doc_id), n, tuple(ids), digest)
            want = []
            for r in was:
                ids = plain.encode(r["text"] or "")
                want.append(show(r["doc_id"], len(ids), ids, hashlib.sha256((r["text"] or "").encode()).hexdigest()))
            assert sorted(want) == sorted(show(r["doc_id"], r["n_tokens"], np.frombuffer(bytes(r["ids"]), "<u4").tolist(), r["decoded_sha256"]) for r in now)


def test_run_and_empty(spark, tables, tmp_path):
    path, _ = tables
    assert pipeline.run(spark, path).columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    for t in ("documents", "labels"):
        spark.read.parquet(f"{path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns(spark, tables, tmp_path):
    """Columns that the stages use themselves, one with a dot and one that is a mere underscore come through unharmed."""
    path, rows = tables
    extra = ", base string, linked long, kept string, `row number` string, `group key` long, id string, component_id long, `a.b` string, `_` string, p double, rate long, x string, clean string"
    more = ("b", 7, "k", "r", 1, "i", 2, "dot", "u", 0.5, 3, "x", "c")
    docs = spark.createDataFrame([(*r, *more) for r in rows], COLUMNS + extra)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, path)
        if name == "encode":
            assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and out.count() == docs.count()
            break
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.schema(docs.schema).parquet(f"{tmp_path}/{name}")
        assert all(tuple(r)[5:] == more for r in docs.collect()) and docs.count() > 50


def test_quality_model_scores_nothing_as_anything():
    model = crf.fit(np.zeros((0, crf.WIDTH)), np.zeros(0), np.zeros(1, int), np.zeros(0))
    assert model.score(pa.array(["", "a"], pa.large_string())).tolist() == [0.5, 0.5]
