"""The corpus pipeline, stage by stage, against plain Python."""

import collections

import corpus_pipeline as P
import numpy as np
import pytest
from test_operators import SF_SMALL, brute_repeats, plain_components, plain_simhash

from riskpanel.llm import toxicity
from riskpanel.llm.queries import TOXIC_AT, tokenizer, toxicity_model


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and result rows of each stage."""
    docs, out = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), {}
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF_SMALL).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (docs, after)
        docs = after
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash", "suffix_array", "decontamination", "packing"]
    for name in ("toxicity", "simhash", "suffix_array", "decontamination"):
        assert stages[name][1].columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxicity_stage(spark, stages):
    before, after = map(rows, stages["toxicity"])
    model = toxicity_model(spark, spark.read.parquet(f"{SF_SMALL}/documents.parquet"), SF_SMALL)
    scored = {r.id: r.score for r in toxicity.scores(stages["toxicity"][0], model).collect()}
    assert after.keys() == {k for k in before if scored[k] < TOXIC_AT} and len(after) > 0.7 * len(before)


def test_simhash_stage(stages):
    before, after = map(rows, stages["simhash"])
    keys = sorted(before)
    label = plain_components([plain_simhash(before[k].text or "") for k in keys], 4)
    assert after.keys() == {keys[c] for c in label} and all(after[k] == before[k] for k in after)


def test_suffix_stage(stages):
    before, after = map(rows, stages["suffix_array"])
    keys = sorted(before)
    assert after.keys() == before.keys()
    for k, m in zip(keys, brute_repeats([before[k].text.encode() for k in keys], 200)):
        raw = before[k].text.encode()
        loose = bytes(b for b, x in zip(raw, m) if not x).decode(errors="ignore")
        assert after[k].n_chars == len(after[k].text) and after[k].text.encode().decode() == after[k].text
        assert len(loose) <= len(after[k].text) <= len(loose) + 2 * m.count(b"\1\0") + 2
        if 1 not in m:
            assert after[k].text == before[k].text


def test_decontamination_stage(spark, stages):
    before, after = map(rows, stages["decontamination"])
    import re
    split = lambda t: [w for w in re.split(r"[^\w]+|_+", (t or "").lower()) if w]
    items = [split(r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    bad = set()
    for k, r in before.items():
        doc, places = split(r.text), collections.defaultdict(list)
        for i, w in enumerate(doc):
            places[w].append(i)
        for item in items:
            diagonals = collections.defaultdict(set)
            for q, w in enumerate(item):
                for p in places.get(w, ()):
                    diagonals[p - q].add(q)
            for d, at in diagonals.items():
                lo, hi = max(0, -d), min(len(item), len(doc) - d)
                if any(len(at & set(range(s, s + 13))) >= 11 for s in range(lo, hi - 12)):
                    bad.add(k)
    assert before.keys() - after.keys() == bad


def test_packing_stage(spark, stages):
    from tokenizers import Tokenizer
    before = rows(stages["packing"][0])
    plain = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    placed, seqs = collections.Counter(), collections.defaultdict(list)
    for r in stages["packing"][1].collect():
        placed[r.doc_id] += r.length
        seqs[r.sequence_id].append((r.offset, r.length))
    assert placed == {k: len(plain.encode(r.text, add_special_tokens=False).ids) + 1 for k, r in before.items()}
    for parts in seqs.values():
        ends = np.cumsum([n for _, n in sorted(parts)]).tolist()
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_run_gives_the_last_stage(spark, stages):
    got = P.run(spark, SF_SMALL)
    assert sorted(map(tuple, got.drop("sequence_id", "offset").collect())) == \
        sorted(map(tuple, stages["packing"][1].drop("sequence_id", "offset").collect()))


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, docs, SF_SMALL).count() == 0, name


def test_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words here", "en", "s", 15),
                                  (3, "word " * 20_000, "en", None, 100_000), (2, "", "en", "s", 0)], schema)
    for name, stage in P.STAGES:
        docs = stage(spark, docs, SF_SMALL)
        assert docs.count() >= 3, name


def test_toxicity_module_never_sees_labels_as_input():
    import inspect
    assert not {"lang", "source", "label"} & set(inspect.signature(toxicity.scores).parameters)
