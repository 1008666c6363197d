"""Trust and distrust reach every linked host, however far and however small."""

from test_urltrust import ROWS, brute, pages

from planloom.llm import urltrust


def verdicts(spark, rows):
    return {r.host: r.verdict for r in urltrust.judge_urls(pages(spark, rows)).collect()}


def test_far_hosts_are_judged(spark):
    bad = "http://bad.example.org/es/1"
    rows = [(0, bad, "")] + [(i, f"http://h{i}.net/", f'<a href="{f"http://h{i - 1}.net/" if i > 1 else bad}">') for i in range(1, 13)]
    assert set(verdicts(spark, rows).values()) == {"block"}


def test_small_ranks_are_judged(spark):
    rows, to = [(0, "http://bad.example.org/es/1", "")], "http://bad.example.org/"
    for k in range(1, 5):  # one page in 1001 of those that link
        rows += [(k, f"http://h{k}.net/", f'<a href="{to}">')] + [(10000 * k + i, f"http://popular{k}.net/{i}", f'<a href="{to}">') for i in range(1000)]
        to = f"http://h{k}.net/"
    assert verdicts(spark, rows)["h4.net"] == "block"


def test_against_many_rounds(spark):
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urltrust.judge_urls(pages(spark, ROWS)).collect()), key=str)
    assert got == brute(ROWS)
