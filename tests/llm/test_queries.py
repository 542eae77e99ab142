"""Queries that SQL can't state, over the whole tables, against brute force or what must hold of them."""

from collections import Counter, defaultdict

import pytest

import oracle
from sievemark.llm import queries
from sievemark.llm.byte_bpe import path_of
from sievemark.llm.visual_form import Tables
from test_text import slow_form


def rows(spark, name):
    return queries.QUERIES[name](spark, oracle.DATA).collect()


def read(sql):
    return oracle.connect().execute(sql).fetchall()


def test_every_query_is_tested():
    here = {"p1_sample", "p3_assignment", "p3_forest", "p3_report", "p7_ids", "p7_roundtrip", "p8_mixture", "p8_report", "p9_found", "p9_forms"}
    assert set(queries.SQL) | here == set(queries.QUERIES)


def test_sample_takes_its_seats(spark):
    sample, report = rows(spark, "p1_sample"), {r.stratum_id: r for r in rows(spark, "p1_report")}
    assert len({r.image_id for r in sample}) == len(sample) > 50
    assert Counter(r.stratum_id for r in sample) == {s: r.seats for s, r in report.items() if r.seats}
    # no drawn record beyond the floor has a greater priority than one left out could have had
    floors = dict(read("select stratum_id, min_rows from sample_target"))
    beyond = [sorted(x.priority for x in sample if x.stratum_id == s and x.priority is not None)[floors[s] :] for s in report]
    highest = max((p for ps in beyond for p in ps), default=0.0)
    for s, r in report.items():
        if r.seats < r.available and r.target_share:
            assert (r.seats + 0.5) / r.target_share >= highest - 1e-6


def test_assignment_report_and_shares(spark):
    placed, report = rows(spark, "p3_assignment"), rows(spark, "p3_report")
    whole = Counter()
    for r in report:
        whole[r.split] += r.images
    assert whole == Counter(r.split for r in placed) and len({r.image_id for r in placed}) == len(placed)
    assert len({(r.group_id, r.split) for r in placed}) == len({r.group_id for r in placed})
    for split, share in read("select split, share from split_target"):
        assert abs(whole[split] / len(placed) - share) < 0.03


def test_tokens_of_all_documents(spark):
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(path_of().replace(".tiktoken", ".json"))
    theirs.encode_special_tokens = True
    texts = dict(read("select doc_id, text from documents"))
    ids = {r.doc_id: r.ids for r in rows(spark, "p7_ids")}
    assert ids == {i: theirs.encode(t, add_special_tokens=False).ids if t else [] for i, t in texts.items()}
    assert {r.doc_id: r.text for r in rows(spark, "p7_roundtrip")} == {i: t or "" for i, t in texts.items()}


def test_mixture_and_its_report(spark):
    chosen, report = rows(spark, "p8_mixture"), {r.source: r for r in rows(spark, "p8_report")}
    taken, longest = Counter(), defaultdict(int)
    for r in chosen:
        taken[r.source] += r.tokens * r.repeats
        longest[r.source] = max(longest[r.source], r.tokens)
        assert 1 <= r.repeats <= report[r.source].max_repeats
    goals = {s: (w, m) for s, w, m in read("select source, target_weight, max_repeats from mix_target")}
    assert set(report) == set(goals) and len({r.doc_id for r in chosen}) == len(chosen)
    for s, r in report.items():
        assert r.taken == taken[s] and r.falls_short == (r.available * goals[s][1] < r.budget)
        assert abs(r.actual_share - r.taken / sum(taken.values())) < 1e-9
        if not r.falls_short:
            assert abs(r.taken - r.budget) <= longest[s]


def test_forms_and_pairs_of_all_documents(spark):
    tables = Tables()
    texts = dict(read("select doc_id, text from documents"))
    want = {i: slow_form(tables, t) for i, t in texts.items()}
    assert {r.doc_id: r.form for r in rows(spark, "p9_forms")} == want
    groups = defaultdict(list)
    for i, form in want.items():
        if texts[i] is not None and form.strip(" \n"):
            groups[form].append(i)
    pairs = {(a, b) for g in groups.values() for a in g for b in g if a < b and texts[a] != texts[b]}
    assert {(r.doc_id_a, r.doc_id_b) for r in rows(spark, "p9_found")} == pairs and pairs
