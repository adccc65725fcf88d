import os
import subprocess
import sys

import numpy as np

from textquarry.llm.pii import Tagger, find_personal_data, plausible, redact, spans, tag_texts
from textquarry.llm.pii_labels import ascii_digits, thai_id_valid
from textquarry.llm.pii_train import crf, gradients

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_gradients():
    m = Tagger(5)
    rng = np.random.default_rng(0)
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64)
    x = rng.integers(1, 40, (3, 8)).astype(np.uint8)
    x[1, 6:] = 0
    y = rng.integers(0, 11, (3, 8))
    _, g = gradients(m, x, y)
    for k in m.p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, e = m.p[k][at], 1e-2
        m.p[k][at] = old + e
        up = gradients(m, x, y)[0]
        m.p[k][at] = old - e
        down = gradients(m, x, y)[0]
        m.p[k][at] = old
        assert abs((up - down) / 2 / e - g[k][at]) < 1e-2 * max(1, abs(g[k][at]))


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(1)
    m = Tagger(4)
    m.p["t"] = rng.normal(0, 1, m.p["t"].shape).astype(np.float32)
    e = rng.normal(0, 1, (1, 4, 11)).astype(np.float32)
    best = max(itertools.product(range(11), repeat=4), key=lambda p: sum(e[0, i, k] for i, k in enumerate(p)) + sum(m.p["t"][a, b] for a, b in zip(p, p[1:])))
    assert m.viterbi(e, np.array([4]))[0].tolist() == list(best)
    loss, _, _ = crf(e.transpose(1, 0, 2).astype(float), np.array([[k] for k in best]), np.ones((4, 1), bool), m.p["t"].astype(float))
    assert loss > 0


def test_known_pieces():
    text = "Contributor: Dr. Joustiamie Pimpsen. Tel. 083-555-6016 or mail info409 [at] thauckiaslab [dot] example. Parcels go to 75 Joexolcrest Avenue, Claitbrook 52696."
    (tags,) = tag_texts(Tagger.load(), [text])
    assert sorted(k for _, _, k in spans(text, tags)) == ["email", "person_name", "phone", "street_address"]
    for clean in ("Version 53.49.13 of the quantile decays under load on node 6.", "Dolkulsen Road is closed for repairs.", "Prices: 10 @ 82.50 each, order 58-75933.", ""):
        (tags,) = tag_texts(Tagger.load(), [clean])
        assert not spans(clean, tags)


def test_long_texts_are_tagged_to_the_end():
    filler = "It took 469 days before the bright kettle could be reopened during the strike. "
    text = filler * 40 + "Tel. 093-000-8100 " + filler * 40 + "Contact: info354@brompmail.example.org"
    (tags,) = tag_texts(Tagger.load(), [text])
    assert [k for _, _, k in spans(text, tags)] == ["phone", "email"]


def test_check_digits():
    body = "012345678901"
    right = [d for d in "0123456789" if thai_id_valid(body + d)]
    assert len(right) == 1
    assert plausible(body + right[0], "id_number") and not plausible(body + ("1" if right[0] != "1" else "2"), "id_number")
    assert ascii_digits("๐๑ 9") == "01 9"


def test_frames(spark):
    rows = [(1, "Call 097 000 4972 x31 after nine. Call 083-555-6016 after nine.", "a"), (2, None, "b"), (3, "", "c"), (4, "   ", None), (5, "Nobody in Lurnum had sold a crooked ferry.", "d")]
    df = spark.createDataFrame(rows, "audit_id bigint, text string, pii_kind string")
    found = sorted(tuple(r)[:3] for r in find_personal_data(df, "audit_id", "text").collect())
    assert found == [(1, "phone", 1), (1, "phone", 2)]
    clean = {r["audit_id"]: (r["text"], r["pieces"]) for r in redact(df, "audit_id", "text").collect()}
    assert clean[1] == ("Call <PHONE> after nine. Call <PHONE> after nine.", 2) and clean[2] == (None, 0) and clean[5][1] == 0
    assert find_personal_data(df.where("audit_id < 0"), "audit_id", "text").count() == 0


def test_held_out_accuracy():
    """A table that wasn't trained on; the labels are those of the patterns and the name list."""
    import pyarrow.parquet as pq
    import pytest

    from textquarry.llm.pii_labels import Names, common_words, label
    from textquarry.llm.pii_train import score

    try:
        texts = [t for t in pq.read_table("/root/testdata/sf0.1/audit_row.parquet")["text"].to_pylist() if t][:3000]
        names = pq.read_table("/root/testdata/sf0.1/person_name.parquet").to_pylist()
    except FileNotFoundError:
        pytest.skip("no tables here")
    known = Names([(r["name"], r["name_kind"], r["script"]) for r in names], common_words(texts))
    for kind, (both, labelled, found) in score(Tagger.load(), texts, known).items():
        # the labels miss names of which the list knows neither part, so the tagger finds a few more
        assert labelled > 20 and both >= 0.97 * labelled and both >= 0.95 * found, kind
    assert label("nothing here", known) == []


def test_made_up_lines_of_other_names():
    """Lines of another seed, without the listed names: what the tagger knows is the form, not the list."""
    from textquarry.llm.pii_templates import Maker
    from textquarry.llm.pii_train import score_spans

    maker = Maker([], ["quiet", "morning", "table", "window", "report"], 99)
    lines = [maker.line([]) for _ in range(500)]
    lines = [(t, [s for s in found if s[2] != "id_number" or plausible(t[s[0] : s[1]], s[2])]) for t, found in lines]
    for kind, (both, made, found) in score_spans(Tagger.load(), lines).items():
        assert made > 50 and both >= 0.95 * made and both >= 0.95 * found, kind
    for text, want in (("Please write to someone@example.org now.", ["email"]), ("call 081-234-5678 or mail a.b@example.org please", ["phone", "email"]), ("The report is by Maria Kowalski of Lisbon.", ["person_name"])):
        (tags,) = tag_texts(Tagger.load(), [text])
        assert [k for _, _, k in spans(text, tags)] == want, text


def test_addresses_with_escaped_at_signs():
    for at in ("&#64;", "&#x40;", "&commat;", "%40", " (AT) "):
        text = f"Build 5 passed. Contact: bouldovic.feasen{at}roarnlab.example.org\nclass Thing: 3 &#60; 4"
        (tags,) = tag_texts(Tagger.load(), [text])
        assert [(text[a:b], k) for a, b, k in spans(text, tags)] == [(f"bouldovic.feasen{at}roarnlab.example.org", "email")], at
    for clean in ("Set x &#60; 40 &amp; y &#62; 64; run again.", "It fell 40% at noon."):
        (tags,) = tag_texts(Tagger.load(), [clean])
        assert not spans(clean, tags)


def test_audit_rows_with_escaped_at_signs(spark):
    """All of them in sf0.1, found whole and made unreadable."""
    import os
    import re

    import pytest

    if not os.path.isdir("/root/testdata/sf0.1"):
        pytest.skip("no tables here")
    rows = spark.read.parquet("/root/testdata/sf0.1/audit_row.parquet").where("text like '%&#64;%'").select("audit_id", "text")
    texts = dict(rows.collect())
    assert len(texts) == 20
    whole = {(i, m.group()) for i, t in texts.items() for m in re.finditer(r"[A-Za-z0-9._+\-]+&#64;[a-z0-9.\-]*[a-z]", t)}
    assert len(whole) == 20
    assert whole <= {(r["audit_id"], texts[r["audit_id"]][r["start"] : r["end"]]) for r in find_personal_data(rows, "audit_id", "text").where("pii_kind = 'email'").collect()}
    assert not [r for r in redact(rows, "audit_id", "text").collect() if "&#64;" in r["text"]]


def test_a_very_long_text_beside_short_ones_takes_bounded_room():
    code = (
        "import resource\n"
        "from textquarry.llm.pii import Tagger, tag_texts, spans\n"
        "mail = ' write to someone@example.org now '\n"
        "texts = ['call 081-234-5678 or mail a.b@example.org please'] * 400 + [mail + 'plain words without anything ' * 7000 + mail]\n"
        "tags = tag_texts(Tagger.load(), texts)\n"
        "assert [k for _, _, k in spans(texts[-1], tags[-1])] == ['email', 'email']\n"
        "assert len({tuple(spans(t, g)) for t, g in zip(texts[:400], tags[:400])}) == 1\n"
        "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)\n"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=ROOT, env={**os.environ, "OMP_NUM_THREADS": "1"})
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout) < 500
