from tidescan.llm import html_extract


def texts(page):
    return " ".join(t for v in html_extract.parse(page) for _, t in v.runs)


def test_head_without_end_tag():
    assert texts("<head><title>t</title><meta charset=utf-8><article><p>one two</p></article>") == "one two"
    assert texts("<head><title>t</title><noscript>x</noscript></head><body><p>one") == "one"


def test_content_of_embedded_elements():
    page = "<article><p>a <math><mi>x</mi></math> b <svg><text>s</text></svg></p><object>o</object><noscript><p>n</p></noscript><script>no</script><style>no</style></article>"
    assert sorted(texts(page).split()) == sorted("a x b s o n".split())
