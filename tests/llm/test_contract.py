"""The registered queries against brute force over sf0.001, whole tables."""

from __future__ import annotations

import hashlib
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

from measurelake.llm import queries

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read(name: str, data: str = DATA) -> pd.DataFrame:
    return pd.read_parquet(f"{data}/{name}.parquet")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def brute_bpe(docs: pd.DataFrame) -> dict:
    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coder = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {}
    for d, t in zip(docs.doc_id, docs.text):
        ids = coder.encode_ordinary(t or "")
        out[d] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(coder.decode_bytes(ids)).hexdigest())
    return out


def brute_statistics(text: str | None) -> tuple:
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def brute_components(docs: pd.DataFrame, n: int = 4, num: int = 85) -> dict:
    sets = {}
    for d, t in zip(docs.doc_id, docs.text):
        w = [x.translate(LOWER) for x in words(t)]
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    index, parent = defaultdict(list), {d: d for d in sets}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for d in sorted(sets):
        shared: Counter = Counter()
        for s in sets[d]:
            shared.update(index[s])
            index[s].append(d)
        for o, both in shared.items():
            if 100 * both >= num * (len(sets[d]) + len(sets[o]) - both):
                a, b = sorted((root(d), root(o)))
                parent[b] = a
    return {d: (len(sets[d]), root(d)) for d in sets}


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def brute_url(url: str | None) -> tuple:
    if url is None or "://" not in url:
        return "", "", None, None
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.DOTALL)
    host, path = m[1].translate(LOWER), m[2]
    best = None
    for verdict, rule in RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return host, path, best and best[1], best and best[0]


def brute_nearest(table: pd.DataFrame) -> dict:
    name = next(c for c in table.columns if c != "vec_id" and hasattr(table[c].iloc[0], "__len__") and not isinstance(table[c].iloc[0], str))
    rows = [(i, np.asarray(v, "f8")) for i, v in zip(table.vec_id, table[name]) if v is not None]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    ids, m = np.array([i for i, _ in rows]), np.array([v / np.linalg.norm(v) for _, v in rows])
    out = {}
    for k in np.flatnonzero(ids % 50 == 0):
        s = m @ m[k]
        s[k] = -9
        order = np.lexsort((ids, -s))[:5]
        out[int(ids[k])] = [int(x) for x in ids[order]]
    return out


def check_bpe(out: pd.DataFrame, data: str) -> None:
    want = brute_bpe(read("documents", data))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.itertuples()} == want


def check_rules(out: pd.DataFrame, data: str) -> None:
    want = {d: brute_statistics(t) for d, t in zip(*(read("documents", data)[c] for c in ("doc_id", "text")))}
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out.itertuples()} == want
    for r in out.itertuples():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def check_mixing(out: pd.DataFrame, data: str) -> None:
    docs = read("documents", data)
    sizes = {d: len(words(t)) for d, t in zip(docs.doc_id, docs.text)}
    docs["size"] = docs.doc_id.map(sizes)
    by = docs.groupby(docs.source.fillna("\U0010ffff"))["size"].sum().sort_index()
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(by.index)}
    target, open_, left = {}, set(by.index), float(by.sum())
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * by[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * by[s] for s in over}
        left -= sum(3.0 * by[s] for s in over)
        open_ -= over
    assert len(out) == len(docs) and dict(zip(out.doc_id, out["size"])) == sizes
    source = dict(zip(docs.doc_id, docs.source.fillna("\U0010ffff")))
    assert (out.taken <= 3 * out["size"]).all() and (out.taken >= 0).all()
    for s, rows in out.groupby(out.doc_id.map(source)):
        assert rows.source_size.eq(by[s]).all()
        assert np.allclose(rows.target, target[s], rtol=1e-9)
        assert abs(rows.taken.sum() - target[s]) <= max(0.02 * target[s], 64), (s, rows.taken.sum(), target[s])


def check_jaccard(out: pd.DataFrame, data: str) -> None:
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.itertuples()} == brute_components(read("documents", data))


def check_urls(out: pd.DataFrame, data: str) -> None:
    pages = read("pages", data)
    want = {p: brute_url(u) for p, u in zip(pages.page_id, pages.url)}
    assert len(out) == len(pages)
    for r in out.itertuples():
        host, path, rule, verdict = want[r.page_id]
        assert (r.host, r.path) == (host, path) and (None if pd.isna(r.rule) else r.rule) == rule
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def check_quality(out: pd.DataFrame, data: str) -> None:
    both = out.merge(read("labels", data), on="doc_id")
    both = both[both.held_out & both.quality.notna()]
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()
    pos, neg = both.score[both.quality == 1], both.score[both.quality == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    print("auc", auc, len(pos), len(neg), "recall", (pos >= 0.3).mean(), "rejected", (neg < 0.3).mean())
    assert auc > 0.8


def check_language(out: pd.DataFrame, data: str) -> None:
    docs = read("documents", data)[["doc_id", "lang", "text"]].merge(out, on="doc_id")
    assert len(docs) == len(out) and out.score.between(0, 1).all()
    held = docs[docs.held_out & docs.lang.notna() & docs.text.fillna("").str.contains(r"[^\W\d_]")]
    print("accuracy", (held.lang == held.lang_pred).mean(), len(held))
    assert (held.lang == held.lang_pred).mean() > 0.9
    assert (docs.lang_pred[~docs.text.fillna("").str.contains(r"[^\W\d_]")] == "und").all()


def check_neighbours(out: pd.DataFrame, data: str) -> None:
    want = brute_nearest(read("embeddings", data))
    got = {q: list(rows.sort_values("rank").vec_id) for q, rows in out.groupby("query_id")}
    recall = sum(len(set(got.get(q, [])) & set(w)) for q, w in want.items()) / sum(map(len, want.values()))
    print("recall", recall)
    assert recall >= 0.9 and set(got) == set(want)


CHECKS = {
    "op1_byte_bpe": check_bpe,
    "op2_quality_rules": check_rules,
    "op4_mixing": check_mixing,
    "op5_ngram_jaccard": check_jaccard,
    "op6_url_filters": check_urls,
    "op7_quality_classifier": check_quality,
    "op9_language_crf": check_language,
    "op10_learned_partitions": check_neighbours,
}


@pytest.mark.parametrize("name", CHECKS)
def test_query(spark, name: str) -> None:
    CHECKS[name](queries.QUERIES[name](spark, DATA).toPandas(), DATA)
