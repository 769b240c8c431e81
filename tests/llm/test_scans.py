import hashlib
import re

import pytest
from llm_common import rows

from meridia.llm.license_scan import PHRASES, allowed_edits, fuzzy_spans, scan_licenses, seeds_of
from meridia.llm.secret_scan import find_secrets, github_checksum, luhn, scan_secrets


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places, labels = [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


@pytest.mark.parametrize("which", ["awkward", "sf_docs"])
def test_license_base_equals_brute_force(which, request):
    docs = request.getfixturevalue(which)
    want = sorted(((r["doc_id"], *brute_licenses(r["text"])) for r in docs.collect()), key=repr)
    found = scan_licenses(docs)
    assert rows(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    for r in found.collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_license_fuzzy_finds_every_notice_with_allowed_edits():
    notice = "gnu general public license"
    assert allowed_edits(notice) == 2 and [s for _, s in seeds_of("abcdef", 2)] == ["ab", "cd", "ef"]
    for text in (notice, notice.replace("public", "publik"), notice.replace("gnu ", "gn "), notice.replace("license", "licence").replace("gnu", "gnn")):
        spans = fuzzy_spans(f" before {text} after ")
        assert any(k == 3 for k, *_ in spans), text
    assert not [s for s in fuzzy_spans(" gnu genera1 pub1ic 1icense ") if s[0] == 3]


def test_license_adjacent_notices_with_different_edits_are_all_found():
    spans = [s for s in fuzzy_spans(" all right reserved all rights reserved ") if s[0] == 9]
    assert [(a > 15, edits) for _, a, _, edits in spans] == [(False, 1), (True, 0)]


def test_license_empty_table(empty):
    assert scan_licenses(empty).collect() == []


def brute_secrets(text):
    text, found = text or "", []
    i = r"(?P<k>[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?(?P<v>[A-Za-z0-9+/_.=-]+)"
    found += [(m.start(), 0, m.end()) for m in re.finditer(i, text) if len(m["v"]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    found.sort()
    said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found)
    return (*(sum(k == n for _, k, _ in found) for n in range(3)), hashlib.sha256(said.encode()).hexdigest(), said)


@pytest.mark.parametrize("which", ["awkward", "sf_docs"])
def test_secret_base_equals_brute_force(which, request):
    docs = request.getfixturevalue(which)
    want = sorted(((r["doc_id"], *brute_secrets(r["text"])[:4]) for r in docs.collect()), key=repr)
    found = scan_secrets(docs)
    assert rows(found, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    for r in found.filter("doc_id is not null").collect():
        base = set(filter(None, brute_secrets(texts[r["doc_id"]])[4].split(",")))
        assert base <= set(r["spans"].split(",")) | {""}


def test_secret_edges():
    assert [x[2] for x in find_secrets("İ password: abcdefghijkl")] == ["assign"]
    assert find_secrets("Koken passwörd=abcdefghijklm toKen=abcdefghijklm") == []
    assert [x[:2] for x in find_secrets("token=token=abcdefghijkl")] == [(0, 24)]
    body = "0123456789ABCDEFGHIJabcdefghij"
    good = f"ghp_{body}{github_checksum(body)}"
    assert [x[2] for x in find_secrets(f"x {good} y")] == ["github"]
    assert find_secrets(f"x ghp_{body}zzzzzz y") == []
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_secret_empty_table(empty):
    assert scan_secrets(empty).collect() == []
