"""Text as columns: tokens, normalisation, visible text of HTML, hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space of tokens, punctuation that normalisation removes, tags whose text is not visible.
SPACES = "[ \\t\\n\\x0B\\f\\r]+"
PUNCTUATION = r"""[!"#$%&'()*+,./:;<=>?@\[\]^_`{|}~]"""
ALL_PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
HIDDEN = ("style", "script", "head", "title", "meta")
HTML_CUTS = (
    "(?is)<!--.*?-->",
    "(?is)<head[^>]*>.*?</head>",
    "(?is)<(script|style)[^>]*>.*?</(script|style)>",
    "(?s)<[^>]*>",
)
# Common English stop words.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself
she she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did doing a an the and but if or because as
until while of at by for with about against between into through during before after above below to from up down in
out on off over under again further then once here there when where why how all any both each few more most other some
such no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain
aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't
mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()


def tokens(text: Column) -> Column:
    """Lower-case words between runs of white space, without empty ones; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES), lambda w: w != "")


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACES}", ""), f"{SPACES}$", "")


def normalized(text: Column, lemma: Callable[[Column], Column] | None = None, hyphens: bool = True) -> Column:
    """A text node for the index: stripped, without digits and punctuation (hyphens and backslashes stay), then the lemma.

    A result of under two characters from an original of over two becomes empty. hyphens=False also removes hyphens and
    backslashes. The lemma is the identity unless one is given.
    """
    start = stripped(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(F.regexp_replace(start, r"\p{Nd}", ""), PUNCTUATION if hyphens else ALL_PUNCTUATION, "")
    out = lemma(out) if lemma else out
    return F.when((F.length(out) < 2) & (F.length(start) > 2), "").otherwise(out)


def is_stop_word(word: Column, words: list[str] = STOP_WORDS) -> Column:
    """Whether the whole, unchanged value is a stop word; null is not."""
    return F.coalesce(word.isin(*words), F.lit(False))


def visible(html: Column) -> Column:
    """Text that a browser shows, by patterns: comments, head, scripts, styles and tags become a space each; entities stay."""
    out = F.coalesce(html, F.lit(""))
    for pattern in HTML_CUTS:
        out = F.regexp_replace(out, pattern, " ")
    return out


def single_line(text: Column, fuse: bool = False) -> Column:
    """Without line breaks: each becomes a space, or nothing with fuse=True."""
    return F.regexp_replace(text, r"\R", "" if fuse else " ")


def html_title(html: Column) -> Column:
    """The title, at most 100 characters; empty without one."""
    return F.substring(F.coalesce(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1), F.lit("")), 1, 100)


def md5_hex(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def java_hash(text: Column) -> Column:
    """The 32-bit string hash s[0]*31^(n-1) + … as decimal text, for texts of the Basic Multilingual Plane."""
    codes = F.transform(F.split(text, ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("long"))
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: (a * 31 + c) % (1 << 32))
    return F.when(text == "", "0").otherwise(F.when(total >= 1 << 31, total - (1 << 32)).otherwise(total).cast("string"))


def normalized_tf(tf: Column, max_tf: Column, a: float = 0.5) -> Column:
    return a + (1 - a) * tf / max_tf


def idf(documents: Column, holding: Column) -> Column:
    return F.log2(documents) - F.log2(holding)


def ceil5(x: Column) -> Column:
    """Up to the next multiple of five."""
    return F.ceil(x / 5) * 5


def clock(seconds: Column) -> Column:
    """Seconds as hours, minutes and seconds."""
    return F.struct((seconds / 3600).cast("long").alias("hours"), (seconds % 3600 / 60).cast("long").alias("minutes"), (seconds % 60).cast("long").alias("seconds"))


def request_seconds(start_ms: Column, end_ms: Column) -> Column:
    """Seconds from a start to an end in milliseconds."""
    return (end_ms - start_ms) / 1000


def worker_list(text: Column) -> Column:
    """Addresses of a list written `[a,b]`, each with http:// before it."""
    inner = F.regexp_replace(text, r"^\s*\[|\]\s*$", "")
    names = F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(names, lambda x: F.when(x.startswith("http"), x).otherwise(F.concat(F.lit("http://"), x)))


class VisibleText(HTMLParser):
    """Collects text nodes whose direct parent is an element that shows its text; decodes entities; drops comments."""

    EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.nodes: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in self.EMPTY:
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1] not in HIDDEN:
            self.nodes.append(data)


def text_nodes(html: str | None) -> list[str]:
    parser = VisibleText()
    parser.feed(html or "")
    parser.close()
    return parser.nodes


def parsed_nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with `nodes`, the visible text nodes by a real parser, in place of `html`; in Arrow batches, no shuffle."""
    rest = [f for f in pages.schema.fields if f.name != html]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "nodes array<string>"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(nodes=frame[html].map(text_nodes)).drop(columns=[html])

    return pages.mapInPandas(run, schema)


def clean_html(pages: DataFrame, html: str = "html", scope: str = "node", lemma: Callable[[Column], Column] | None = None) -> DataFrame:
    """pages with `contents`: visible text nodes, without stop words, normalised and joined with spaces.

    scope "node": a node that as a whole is a stop word goes (case counts); "token": each token that is one goes.
    """
    if scope not in ("node", "token"):
        raise ValueError(scope)
    nodes = parsed_nodes(pages, html)
    if scope == "node":
        kept = F.filter("nodes", lambda n: ~is_stop_word(n))
        text = F.array_join(F.transform(kept, lambda n: normalized(n, lemma)), " ")
    else:
        words = F.flatten(F.transform("nodes", lambda n: F.filter(F.split(n, SPACES), lambda w: (w != "") & ~is_stop_word(F.lower(w)))))
        text = F.array_join(F.transform(words, lambda w: normalized(w, lemma)), " ")
    return nodes.withColumn("contents", text).drop("nodes")
