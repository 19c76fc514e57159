"""The whole pipeline against a brute-force version of its stages on a small fixture."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import test_decontaminate
import test_ngram_join
import test_pii
import test_quality

import corpus_pipeline
from lodestrata.llm import quality

tokenizers = pytest.importorskip("tokenizers")


def kept_by_quality(docs):
    rows = [(d, t or "") for d, t in docs]
    score = dict(zip([d for d, _ in rows], test_quality.kneser_ney([t for _, t in rows]), strict=True))
    base = {d: test_quality.brute(t) for d, t in rows}
    fit = [round(score[d] / quality.BIN) for d, _ in rows if base[d][0] >= quality.MIN_WORDS]
    low, middle, high = (x * quality.BIN for x in np.percentile(fit, [25, 50, 75]))
    out = []
    for d, t in rows:
        slack = quality.SHORT / max(1, len(t)) ** 0.5
        if not base[d][-1] and middle - quality.BELOW * (middle - low) - slack <= score[d] <= middle + quality.ABOVE * (high - middle) + slack:
            out.append((d, t))
    return out


def kept_by_similarity(docs):
    sets = {d: test_ngram_join.gram_set(t, 5) for d, t in docs}
    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return [(d, t) for d, t in docs if label[d] == d]


def redacted(text):
    spans = sorted(((int(s), -int(e), k) for k, s, e in (x.split(":") for x in test_pii.brute(text))))
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, -e)
    return "".join(out) + text[at:] if spans else text


def test_against_brute_force(spark, tmp_path):
    r = random.Random(21)
    word = lambda: "".join(r.choice(["the", "er", "th", "and", "ing", "on", "ou", "re"]) for _ in range(r.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(r.randrange(12, 30))) for k in range(6)]
    docs = [(k, text(r.randrange(20, 120))) for k in range(70)]
    docs += [(100 + k, docs[k][1] + " " + text(2)) for k in range(0, 30, 3)]  # near copies
    docs += [(200 + k, f"{text(20)} {items[k][1]} {text(30)}") for k in range(6)]
    docs += [(300 + k, f"{text(30)} mail {word()}@mail{k}.example.com or +1 (826) 555-73{k}{k} from 10.0.{k}.7 {text(9)}") for k in range(8)]
    docs += [(400 + k, " ".join("".join(r.choice("QXZJKVWY7@~^`{}[]=") for _ in range(7)) for _ in range(60))) for k in range(3)]
    docs += [(500, ""), (501, None), (502, "too short"), (503, "a b c d e " * 9)]
    r.shuffle(docs)
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = kept_by_similarity(kept_by_quality(sorted(docs)))
    leaks = test_decontaminate.brute(left, items)
    left = [(d, redacted(t)) for d, t in left if not leaks[d]]
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d, t in left:
        ids = library.encode(t, add_special_tokens=False).ids
        want[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {x.doc_id: tuple(x)[1:] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want
    assert not {d for d in got if d // 100 in (1, 2, 4, 5)} and {d for d in got if d // 100 == 3} == set(range(300, 308)) and len(got) > 70
