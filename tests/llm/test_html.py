"""HTML extraction: pages that once lost their text or took quadratic time, and the linear scan against all runs."""

import random
import time

import pytest

from quillon.llm import html

WORDS = " ".join(f"word{i}" for i in range(60)) + "."


@pytest.fixture(scope="module")
def model():
    return html.train()


@pytest.mark.parametrize("tag", ['<svg class="i"/>', "<object data=x />", "<math/>", "<iframe src=x>", "<select>", "<template>", "<svg><path d='M0'/></svg>", "<!-- > --> <![CDATA[ <p> ]]>", "<?x y?>"])
def test_text_behind_elements_without_an_inside(model, tag):
    assert html.extract(f"<article><h1>Title</h1>{tag}<p>{WORDS}</p></article>", model) == f"Title\n\n{WORDS}"


def test_scripts_go_to_the_end(model):
    assert html.extract(f"<article><p>{WORDS}</p><script>var x = '<p>" + WORDS, model) == WORDS


def test_quoted_values_hold_any_sign(model):
    assert html.extract(f"<article><p title='a > b' data-x=\"</p>\">{WORDS}</p><p>1 < 2 and \"3\" > 2 {WORDS}</p></article>", model) == f"{WORDS}\n\n1 < 2 and \"3\" > 2 {WORDS}"


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a "' * 250_000, "<a \"' " * 150_000 + ">", '<a "" ' * 170_000, "<a<a" * 250_000 + ' "', "<div class=x>" * 80_000, "".join(f"<div class=c{i}>t" for i in range(60_000)), "<div>" * 50_000 + "</x>" * 50_000, "<select>t " * 100_000, "<!--" * 250_000, "<svg " * 200_000 + "</svg " * 100_000], ids=range(11))
def test_a_megabyte_of_one_kind_takes_seconds(model, page):
    began = time.time()
    html.extract(page, model)
    assert time.time() - began < 20


def test_the_scan_finds_the_best_of_all_runs():
    rng = random.Random(8)
    for _ in range(300):
        n = rng.randrange(0, 14)
        tags, words = [-rng.randrange(3) / 4 for _ in range(n)], [rng.randrange(-4, 5) / 4 for _ in range(n)]
        total = lambda i, j: sum(words[i : j + 1]) + sum(tags[i + 1 : j + 1])
        most = max((total(i, j) for i in range(n) for j in range(i, n)), default=0.0)
        first, last, best = html.best_run(tags, words)
        assert best == max(most, 0.0)
        assert last < first or total(first, last) == best
