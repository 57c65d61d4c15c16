"""The context of a block is its whole page."""

import numpy as np

from lodestone.llm import html_blocks as H


def test_states_run_through_long_pages():
    # a model that remembers a block with © and takes all blocks from there on
    ahead, back = (np.zeros((H.INPUT + H.HIDDEN + 1, 4 * H.HIDDEN), np.float32) for _ in range(2))
    ahead[H.INPUT - 1, 0], ahead[-1, 0] = 20, -12
    ahead[-1, H.HIDDEN], ahead[-1, 2 * H.HIDDEN] = 18, 10
    ahead[H.INPUT - 1, 3 * H.HIDDEN] = 10
    out = np.zeros(2 * H.HIDDEN + 1, np.float32)
    out[0], out[-1] = 10, -3
    page = "<p>before</p><p>© begins</p>" + "".join(f"<p>line {i}</p>" for i in range(1500))
    pages = [page, "<p>short</p>", "", page]
    got = H.main_texts((ahead, back, out), pages)
    want = "\n\n".join(["© begins", *[f"line {i}" for i in range(1500)]])
    assert got == [want, "", "", want]
