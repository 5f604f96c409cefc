import html

from pyspark.sql import functions as F

from moderata.functions import arrays as ar
from moderata.functions import references
from moderata.functions import text as tx


def one(spark, value, expression, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(expression(F.col("x"))).first()[0]


def test_html_to_text(spark):
    page = (
        '<html><head><title>t</title><style>p{}</style></head><body><!-- c\n <b> --><h1>A  &amp; B</h1>'
        '<script>var t="</p>";</script><p>one<br>two <a href="x">link</a></p>\n\n<div>caf&#233; &#x41;&#xZZ; &lt;x&gt;'
        "&amp;lt; 1 < 2</div></body></html>"
    )
    assert one(spark, page, tx.html_to_text) == "A & B\none\ntwo link\ncafé A&#xZZ; <x>&lt; 1 < 2"
    assert one(spark, None, tx.html_to_text) is None
    assert one(spark, "plain &#9999999; &# &#5", tx.html_to_text) == "plain &#9999999; &# &#5"


def test_references_agree_with_the_standard_library(spark):
    """All names, alone, followed by letters and without their semicolon; nothing is decoded twice."""
    cases = [f"a &{name} b &{name}c &{name.rstrip(';')}" for name in html.entities.html5]
    cases += ["&amp;lt;", "&#38;lt;b&#62;", "&amp;amp;eacute;", "&notit; &notin; &unknown; & &; &&lt", "&#x1F600;&#8364;", ""]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, x string")
    got = df.select("i", references.decode_references(F.col("x")).alias("y")).collect()
    assert len(got) == len(cases)
    plain = lambda text: text.replace("©", "(C)").replace("\xa0", " ")
    assert [plain(r.y) for r in sorted(got)] == [plain(html.unescape(case)) for case in cases]


def test_references_that_stay(spark):
    for kept in ("&#0;", "&#xD800;", "&#1114112;", "&#12", "&nosuch;", "&"):
        assert one(spark, kept, references.decode_references) == kept
    assert one(spark, None, references.decode_references) is None


def test_quoted_attributes(spark):
    assert one(spark, '<a title="x>y" b=\'>\'>z</a><p class = "a>b">w</p><i x=1>v</i> a<b', tx.html_to_text) == "z\nw\nv a<b"
    long = "<i " + 'a="1>" b=2 ' * 2000 + ">t</i>"
    assert one(spark, long, tx.html_to_text) == "t"


def test_sentences_cover_the_text(spark):
    text = " Hi there!  How are you?\nFine. no end"
    parts = one(spark, text, tx.sentences)
    assert "".join(parts) == text and len(parts) == 4


def test_chat_and_system(spark):
    f = lambda c: tx.chat_message("user", c, add_generation_prompt=True)
    assert one(spark, "hi", f) == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n"
    assert one(spark, None, tx.system_prefix) == ""
    assert one(spark, "", tx.system_prefix) == ""
    assert one(spark, "x", tx.system_prefix) == "<|im_start|>system\nx<|im_end|>\n"


def test_retrieval_prompt(spark):
    f = lambda c: tx.retrieval_prompt(c, F.lit("ctx"))
    assert one(spark, "q", f) == "You are given the following context: ctx\nIs the following hate speech: q"
    assert one(spark, None, f) is None
    g = lambda c: tx.retrieval_prompt(c, F.lit(None).cast("string"))
    assert one(spark, "q", g) == "You are given the following context: \nIs the following hate speech: q"


def test_duration(spark):
    want = {0.5: "0:00:00", 1.5: "0:00:02", 3725.0: "1:02:05", 90061.0: "1 day, 1:01:01", 180000.0: "2 days, 2:00:00"}
    for seconds, shown in want.items():
        assert one(spark, seconds, tx.duration, "double") == shown


def test_numbers(spark):
    assert one(spark, 40, tx.thousands, "bigint") == "   40"
    assert one(spark, 12345678, tx.thousands, "bigint") == "12,345,678"
    assert one(spark, 1234.567, tx.two_decimals, "double") == "1234.57"


def test_argmax(spark):
    assert one(spark, [1.0, 3.0, 3.0], ar.argmax, "array<double>") == 1
    assert one(spark, None, ar.argmax, "array<double>") is None


def test_term_counts(spark):
    got = one(spark, "b a b c b a", lambda c: ar.term_counts(tx.tokens(c)))
    assert [(r.term, r.tf) for r in got] == [("a", 2), ("b", 3), ("c", 1)]
    assert one(spark, "", lambda c: ar.term_counts(tx.tokens(c))) == []
    assert one(spark, None, lambda c: ar.term_counts(tx.tokens(c))) == []
