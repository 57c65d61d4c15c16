"""Pages that no tag ends, or that nest deeply, are read in linear time; broken tags are text."""

import time

import pytest

from lodestone.llm import html_blocks as H


@pytest.mark.parametrize("page", ["<a " * 1_700_000, '<a "' * 1_250_000, "<a '\"" * 1_000_000 + ">", "</script " * 300_000, "<script>" + "</script " * 300_000, "<!" * 2_000_000, "<!--" * 1_000_000, "<div>x" * 60_000, "<p><li>x" * 40_000, "<a<" * 1_000_000 + ">"], ids=range(10))
def test_linear(page):
    began = time.process_time()
    H.blocks(page)
    assert time.process_time() - began < 6


def test_broken_tags_are_text():
    text = lambda page: [t for t, *_ in H.blocks(page)]
    assert text("<p>1 < 2 and <b") == ["1 < 2 and <b"]
    assert text('<p>a</p><div title="x > y">b</div>') == ["a", "b"]
    assert text("<p>a <!-- <p>no</p> --> b</p>c") == ["a b", "c"]
    assert text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert text("<script>var x = '<p>no</p>'</script >yes<style>p{}") == ["yes"]
    assert text("<p>a<p>b<select><option>no<option>no</select>c") == ["a", "b", "c"]
    assert text("x&amp;y&nbsp;z<br>w<hr/>v") == ["x&y z w", "v"]
