"""What the licence scan and the quality rules say, recomputed the plain way over every document."""

import re

from quillon.llm import licences, quality

SF = "/root/testdata/sf0.01"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parsed(tokens):
    """(names, permissive) of a licence expression by recursive descent, or None; prose may follow it."""

    def either(at):
        got, at = both(at)
        while got and at < len(tokens) and tokens[at].lower() == "or":
            other, at = both(at + 1)
            got = other and (got[0] | other[0], got[1] or other[1])
        return got, at

    def both(at):
        got, at = one(at)
        while got and at < len(tokens) and tokens[at].lower() == "and":
            other, at = one(at + 1)
            got = other and (got[0] | other[0], got[1] and other[1])
        return got, at

    def one(at):
        if at < len(tokens) and tokens[at] == "(":
            got, at = either(at + 1)
            return (got, at + 1) if got and at < len(tokens) and tokens[at] == ")" else (None, at)
        if at >= len(tokens) or tokens[at].lower() in ("and", "or", "with", ")"):
            return None, at
        name = tokens[at].lower()
        got = frozenset([name]), not name.startswith(licences._COPYLEFT)
        if at + 1 < len(tokens) and tokens[at + 1].lower() == "with":
            other = tokens[at + 2].lower() if at + 2 < len(tokens) else ")"
            return (None, at) if other in ("and", "or", "with", "(", ")") else ((frozenset([f"{name}-with-{other}"]), True), at + 3)
        return got, at + 1

    return either(0)[0]


def test_labels_of_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = [(-1, "SPDX-License-Identifier: MIT OR (GPL-2.0-only WITH Classpath-exception-2.0 AND Apache-2.0)"), (-2, "SPDX-License-Identifier: AND MIT"), (-3, "CC  by, General-Public LICENSE"), (-4, "spdx-license-identifier: (MIT\nAll rights, reserved"), (-5, None)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    seen = set()
    for r in licences.scan_licences(docs).collect():
        line = f" {' '.join(re.findall(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+', (r.text or '').translate(LOW)))} "
        labels, base = set(), {label for phrase, label in licences.BASE.items() if f" {phrase} " in line}
        labels = base | {label for phrase, (label, _) in licences.MORE.items() if f" {phrase} " in line}
        if f" {licences.TAG} " in line:
            for m in licences._TAG.finditer(r.text):
                got = parsed(licences._TOKEN.findall(m[1]))
                if got:
                    labels |= {f"spdx:{n}" for n in got[0]} | {"spdx-permissive" if got[1] else "spdx-copyleft"}
        assert (r.labels, r.base_labels) == (",".join(sorted(labels)), ",".join(sorted(base))), (r.doc_id, r.labels)
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels)
        seen |= labels
    assert len(seen) > 5


def test_kept_of_every_document(spark):
    """Every document judged alone, by the base rules spelled out and the model's thresholds."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    import pyarrow as pa

    kept = 0
    for r in quality.apply_rules(docs, labels).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        many = {w for w in windows if windows.count(w) > 1} if len(words) < 400 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
        repeated = {i + j for i, w in enumerate(windows) if w in many for j in range(3)}
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        good, toxic = model.probabilities(quality.Texts(pa.array([r.text]), lower=True))[0]
        assert abs(good - r.p_good) < 1e-9 and abs(toxic - r.p_toxic) < 1e-9
        assert (r.base_failed, r.kept) == (failed, not failed and good >= quality.GOOD_AT_LEAST and toxic < quality.TOXIC_BELOW), r.doc_id
        kept += r.kept
    assert kept > 100
