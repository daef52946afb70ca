"""The pipeline against brute force, stage by stage on what the stage before kept."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from foliate.llm import bpe, quality_cnn, simhash
from tests.llm.helpers import awkward, nothing
from tests.llm.test_dedup import _roots
from tests.llm.test_text_ops import _holding
from tokenizers import Tokenizer


def _without_boilerplate(rows):
    pages, counts = defaultdict(set), Counter()
    for source, text in rows.values():
        pages[source].add(text)
    for source, texts in pages.items():
        for t in texts:
            counts.update((source, x) for x in {y.strip(" ") for y in t.split("\n")} if x)
    cut = {k for k, n in counts.items() if n >= 4 and n > 0.1 * len(pages[k[0]])}
    return {d: "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in cut) for d, (s, t) in rows.items()}


def _groups(texts):
    """Root document of each: 5-word shingle sets similar to 0.8 or more, or fingerprints of them within two bits."""
    words = {d: re.findall("[^\x20\x09-\x0d]+", t.translate({c: c + 32 for c in range(65, 91)})) for d, t in texts.items()}
    sets = {d: {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4) if w else 0)} for d, w in words.items()}
    fps = {d: simhash.fingerprint(t, 5) for d, t in texts.items()}

    def linked(a, b):
        shared = len(sets[a] & sets[b])
        return (fps[a] ^ fps[b]).bit_count() <= 2 or shared > 0 and shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared)

    return _roots(sorted(texts), linked)


def test_run_same_as_brute_force(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    docs = {r["doc_id"]: (r["source"], r["text"]) for r in read("documents").collect()}
    net = quality_cnn.fit(read("documents"), read("labels"))
    scores = dict(zip(docs, quality_cnn.score_texts(net, [t for _, t in docs.values()])))
    kept = _without_boilerplate({d: x for d, x in docs.items() if scores[d] >= quality_cnn.KEEP})
    roots = _groups(kept)
    kept = {d: t for d, t in kept.items() if roots[d] == d}
    held = {d for d, _ in _holding(kept, {r["item_id"]: r["text"] for r in read("benchmark").collect()})}
    tokenizer = Tokenizer.from_file(bpe.default_path())
    want = {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in kept.items() if d not in held}
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert len(want) < len(docs)
    assert got == want


def test_stages_keep_columns_and_take_awkward_tables(spark, sf_dir):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, awkward(spark), sf_dir)
        assert out.columns == awkward(spark).columns, name
        assert out.count() > 0
        assert stage(spark, nothing(spark), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, awkward(spark), sf_dir).count() == awkward(spark).count()
