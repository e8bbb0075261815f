"""Only an attribute of the very name hides an element, not a word inside another attribute."""

import pytest

from tabulith.llm import extraction

TEXT = "It is a text of the kind that is read and that has more than a few of the words which it was to have."


@pytest.mark.parametrize("attr", ['style="overflow:hidden"', "style='overflow: hidden; x: y'", 'alt="hidden"', "title='a hidden id=footer'", "data-hidden", 'data-id="footer"', 'aria-hidden="false"', "href=/a/hidden", 'title="x""hidden"'])
def test_kept(attr):
    assert extraction.extract(f"<body><div {attr}><article><p>{TEXT}</p></article></div></body>") == TEXT


@pytest.mark.parametrize("attr", ["hidden", "HIDDEN", 'hidden=""', "style='a:b' hidden", 'aria-hidden = "true"', 'class="x footer"', "id=sidebar", 'title="x"hidden'])
def test_dropped(attr):
    assert extraction.extract(f"<body><div {attr}><article><p>{TEXT}</p></article></div></body>") == ""
