"""Main text of web pages: a bidirectional LSTM labels every block from its tag path, its words and the whole page."""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwarden.llm.sampling import sample

# Elements that begin a block of their own, that hold no text to read, that close others, that are empty.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td "
    "tfoot th thead tr ul".split())
UNREAD = "script|style|noscript|template|iframe|object|svg|math|textarea|title|canvas|audio|video|noframes|noembed|xmp"
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
EMPTY = frozenset("hr br img input meta link base area col embed source track wbr param".split())
# Tags and names by which pages mark what is no article, and what is.
OTHER_TAGS = ("nav", "aside", "footer", "form", "header", "menu", "dialog", "button", "select", "search")
OTHER_NAMES = (
    "nav menu navbar breadcrumb header masthead topbar footer bottom sidebar widget related recommended ad ads advert advertisement "
    "banner promo sponsored sponsor cookie cookies consent notice alert popup modal overlay newsletter subscribe signup login share social "
    "comment comments reply replies discussion respond form search pagination pager tags copyright legal disclaimer toolbar skip").split()
MAIN_TAGS = ("article", "main")
MAIN_NAMES = "article content main post story entry body text article-body post-content entry-content main-content".split()
INSIDE = [t.split() for t in ("ul li", "ul li", "ul li", "ol li", "ol li", "blockquote", "blockquote p", "table tr td", "table tbody tr th", "pre", "dl dd", "h2", "h3", "figure figcaption", "div", "div p", "section p", "section h2")]

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{UNREAD})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\b[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>"
    r"|<[!?/][^>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|\b(hidden)\b""", re.I)
PATHS, WORDS, EXTRA = 512, 64, 4
WIDTH = PATHS + WORDS + EXTRA
HIDDEN = 16


@dataclass
class Block:
    path: list[tuple[str, tuple[str, ...]]]
    inner: set[str] = field(default_factory=set)
    text: str = ""
    linked: int = 0


def names_of(rest: str) -> tuple[str, ...]:
    """Parts of class, id and role, and `hidden` for what is not shown."""
    if "=" not in rest and "hidden" not in rest.lower():
        return ()
    out = []
    for kind, a, b, c, hidden in ATTRIBUTE.findall(rest):
        value = (a or b or c).lower()
        if hidden or (kind.lower() == "style" and re.search(r"display\s*:\s*none", value)):
            out.append("hidden")
        elif kind.lower() != "style":
            out += [x for name in value.split() for x in {name, *re.split("[-_]", name)} if x]
    return tuple(sorted(set(out)))


def blocks(page: str | None) -> list[Block]:
    """Blocks with text in page order, character references decoded, white space as one space, trimmed.

    Elements that begin a block part the text, all others do not; scripts, styles and the like are not read. Unclosed
    elements end where a later tag ends them.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    inner: set[str] = set()
    links, linked, at = 0, 0, 0
    page = page or ""

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        if text and not any(t == "head" for t, _ in stack):
            out.append(Block(list(stack), set(inner), text, min(linked, len(text))))
        parts.clear()
        inner.clear()
        linked = 0

    def close(names: set[str], within: frozenset | set = frozenset()) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in within:
                return

    for m in TAG.finditer(page):
        if m.start() > at:
            piece = page[at:m.start()]
            parts.append(piece)
            linked += len(piece) if links > 0 else 0
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if name not in BLOCKS:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                links = max(0, links - 1) if m["end"] else 1
            if not m["end"]:
                inner.add(name)
            continue
        flush()
        links = 0
        if m["end"]:
            close({name})
            continue
        if name in CLOSES:
            close(CLOSES[name], {"ul", "ol", "dl", "table", "select", "menu"})
        else:
            close({"p"}, {"td", "th", "li", "div", "article", "section", "body"})
        if name == "body":
            close({"head"})
        if name not in EMPTY:
            stack.append((name, names_of(m["rest"] or "")))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def _slot(token: str, width: int) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % width


@lru_cache(1 << 17)
def _word_slot(word: str) -> int:
    return _slot(word, WORDS)


_slots: dict[str, int] = {}


def vectors(page: list[Block]) -> np.ndarray:
    """One row a block: hashed tags and names of its path, hashed words, length, share of links, place."""
    x = np.zeros((len(page), WIDTH), dtype=np.float32)
    for i, b in enumerate(page):
        tokens = {"last:" + t for t, _ in b.path[-1:]} | {t for t, _ in b.path} | {"." + n for _, ns in b.path for n in ns} | {"in:" + t for t in b.inner}
        for t in tokens:
            if t not in _slots:
                if len(_slots) > 100_000:
                    _slots.clear()
                _slots[t] = _slot(t, PATHS)
            x[i, _slots[t]] = 1.0
        words = Counter(b.text.lower().split())
        share = 1.0 / (1 + words.total())
        for w, n in words.items():
            x[i, PATHS + (_word_slot(w) if len(w) < 64 else _slot(w, WORDS))] += n * share
        x[i, -EXTRA:] = np.log1p(len(b.text)) / 8, b.linked / len(b.text), i / len(page), 1.0
    return x


def weak_labels(page: list[Block]) -> list[int] | None:
    """1 inside an article or main element unless something in the path marks the block as other; None without either."""
    if not any(t in MAIN_TAGS for b in page for t, _ in b.path):
        return None
    out = []
    for b in page:
        kinds = [t for t, _ in b.path]
        start = min((kinds.index(t) for t in MAIN_TAGS if t in kinds), default=None)
        other = any(t in OTHER_TAGS or set(ns) & {*OTHER_NAMES, "hidden"} for t, ns in b.path)
        out.append(int(start is not None and not other))
    return out


def varied(page: list[Block], labels: list[int], texts: list[str], rnd: np.random.Generator) -> tuple[list[Block], list[int]]:
    """The page with its kinds of elements under other common tags and names, and with more of what is no article."""
    renamed: dict[tuple[str, tuple[str, ...]], tuple[str, tuple[str, ...]]] = {}

    def other() -> tuple[str, tuple[str, ...]]:
        if rnd.random() < 0.4:
            return str(rnd.choice(OTHER_TAGS)), ()
        name = str(rnd.choice(OTHER_NAMES))
        return str(rnd.choice(["div", "section", "ul"])), tuple({name, *( ["box"] if rnd.random() < 0.3 else [])})

    def rename(e: tuple[str, tuple[str, ...]]) -> tuple[str, tuple[str, ...]]:
        if e not in renamed:
            tag, ns = e
            if tag in MAIN_TAGS:
                renamed[e] = ("article", ()) if rnd.random() < 0.4 else ("main", ()) if rnd.random() < 0.4 else ("div", (str(rnd.choice(MAIN_NAMES)),))
            elif (tag in OTHER_TAGS or set(ns) & set(OTHER_NAMES)) and rnd.random() < 0.7:
                renamed[e] = other()
            else:
                renamed[e] = e
        return renamed[e]

    out = [Block([rename(e) for e in b.path], b.inner, b.text, b.linked) for b in page]
    labels = list(labels)
    share = rnd.choice([0.0, 0.2, 0.6])
    for b, y in zip(out, labels):
        if y and rnd.random() < share:
            b.path = [*b.path[:-1], *[(t, ()) for t in INSIDE[int(rnd.integers(0, len(INSIDE)))]]]
            if rnd.random() < 0.3:
                b.text = " ".join(b.text.split()[:int(rnd.integers(1, 4))])
            if rnd.random() < 0.2:
                b.inner, b.linked = b.inner | {"a"}, len(b.text) // int(rnd.integers(1, 4))
    root = [e for e in page[0].path[:2]] if page else []
    for _ in range(int(rnd.integers(1, 6))):
        at = int(rnd.integers(0, len(out) + 1))
        mains = [i for i, y in enumerate(labels) if y]
        if mains and rnd.random() < 0.5:
            at = int(rnd.choice(mains))
        inside = list(out[at].path[:-1]) if at < len(out) and rnd.random() < 0.7 else root
        path, count = [*inside, other()], int(rnd.integers(1, 5))
        new = []
        for _ in range(count):
            text = texts[int(rnd.integers(0, len(texts)))] if texts else "more"
            link = rnd.random() < 0.3
            new.append(Block([*path, (str(rnd.choice(["p", "li", "div", "h3"])), ())], {"a"} if link else set(), text, len(text) if link else 0))
        out[at:at] = new
        labels[at:at] = [0] * count
    return out, labels


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs, one from the first block on and one from the last, and a logistic output over both states."""

    def __init__(self, seed: int = 5) -> None:
        rnd = np.random.default_rng(seed)
        scale = 0.1
        self.p = {
            "wx": rnd.normal(0, scale, (2, WIDTH, 4 * HIDDEN)), "wh": rnd.normal(0, scale, (2, HIDDEN, 4 * HIDDEN)),
            "b": np.zeros((2, 1, 4 * HIDDEN)), "v": rnd.normal(0, scale, (2 * HIDDEN + WIDTH, 1)), "c": np.zeros(1),
        }
        self.p["b"][:, :, HIDDEN:2 * HIDDEN] = 1.0
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    @staticmethod
    def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(page, step, feature) and lengths."""
        n = np.array([len(p) for p in pages])
        x = np.zeros((len(pages), int(n.max(initial=0)), WIDTH), dtype=np.float32)
        for i, p in enumerate(pages):
            x[i, :len(p)] = p
        return x, n

    def forward(self, x: np.ndarray, n: np.ndarray, keep: bool = False):
        count, steps, _ = x.shape
        turn = np.arange(steps)[None, :]
        back = np.where(turn < n[:, None], n[:, None] - 1 - turn, turn)
        rows = np.arange(count)[:, None]
        both = np.stack([x, x[rows, back]])
        z_in = both.reshape(2, -1, WIDTH) @ self.p["wx"] + self.p["b"]
        z_in = z_in.reshape(2, count, steps, 4 * HIDDEN)
        h = np.zeros((2, count, HIDDEN), dtype=np.float32)
        c = np.zeros_like(h)
        states = np.zeros((2, count, steps, HIDDEN), dtype=np.float32)
        trace = []
        for t in range(steps):
            z = z_in[:, :, t] + h @ self.p["wh"]
            gates = _sigmoid(z[..., :3 * HIDDEN])
            i, f, o = gates[..., :HIDDEN], gates[..., HIDDEN:2 * HIDDEN], gates[..., 2 * HIDDEN:]
            g = np.tanh(z[..., 3 * HIDDEN:])
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep:
                trace.append((h, c, i, f, o, g, tc))
            h, c = o * tc, c_new
            states[:, :, t] = h
        joined = np.concatenate([states[0], states[1][rows, back], x], axis=2)
        logits = (joined @ self.p["v"])[..., 0] + self.p["c"]
        return logits, (both, back, states, joined, trace)

    def step(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients over the blocks of some pages."""
        logits, (both, back, states, joined, trace) = self.forward(x, n, keep=True)
        count, steps = logits.shape
        live = np.arange(steps)[None, :] < n[:, None]
        p = _sigmoid(logits)
        total = live.sum()
        loss = -np.sum(live * np.where(y == 1, np.log(p + 1e-9), np.log(1 - p + 1e-9))) / total
        d = (live * (p - y) / total).astype(np.float32)[..., None]
        grad = {"v": (joined.reshape(-1, joined.shape[2]).T @ d.reshape(-1, 1)), "c": d.sum(axis=(0, 1))}
        d_states = d @ self.p["v"][:2 * HIDDEN].T
        rows = np.arange(count)[:, None]
        ds = np.stack([d_states[..., :HIDDEN], d_states[rows, back][..., HIDDEN:]])
        dz_all = np.zeros((2, count, steps, 4 * HIDDEN), dtype=np.float32)
        dh, dc = np.zeros((2, count, HIDDEN), dtype=np.float32), np.zeros((2, count, HIDDEN), dtype=np.float32)
        grad["wh"] = np.zeros_like(self.p["wh"])
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, g, tc = trace[t]
            dh = dh + ds[:, :, t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=2)
            dz_all[:, :, t] = dz
            grad["wh"] += h.transpose(0, 2, 1) @ dz
            dh, dc = dz @ self.p["wh"].transpose(0, 2, 1), dc * f
        flat = dz_all.reshape(2, -1, 4 * HIDDEN)
        grad["wx"] = both.reshape(2, -1, WIDTH).transpose(0, 2, 1) @ flat
        grad["b"] = flat.sum(axis=1, keepdims=True)
        return float(loss), grad

    def train(self, pages: list[tuple[np.ndarray, list[int]]], steps: int = 800, batch: int = 16, rate: float = 0.01, seed: int = 6) -> None:
        """Adam over random batches of pages."""
        rnd = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps + 1):
            chosen = rnd.integers(0, len(pages), size=min(batch, len(pages)))
            x, n = self.pad([pages[i][0] for i in chosen])
            y = np.zeros(x.shape[:2], dtype=np.float32)
            for r, i in enumerate(chosen):
                y[r, :n[r]] = pages[i][1]
            _, grad = self.step(x, n, y)
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def label(self, pages: list[np.ndarray], cells: int = 20_000) -> list[np.ndarray]:
        """Whether each block of each page belongs to the article. Pages of similar length are run together."""
        out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
        order = [i for i in np.argsort([len(p) for p in pages], kind="stable") if len(pages[i])]
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(pages[order[end]]) <= cells:
                end += 1
            x, n = self.pad([pages[i] for i in order[at:end]])
            logits, _ = self.forward(x, n)
            for r, i in enumerate(order[at:end]):
                out[i] = logits[r, :n[r]] >= 0
            at = end
        return out


def fit(pages: DataFrame, key: str = "page_id", html: str = "html", rows: int = 400, variants: int = 8) -> Labeller:
    """Train on a bounded sample of pages: `rows` pages of up to 60,000 characters and 200 blocks, as they are and varied.

    Pages have no labels. Those with an article or main element are labelled by it; then their elements get other tags
    and names and more side matter is mixed in, so that the network must go by names, words and neighbours. Without such
    pages, the network learns from variations of one written page.
    """
    got = sample(pages.select(F.lit(0).alias("label"), pages[key].alias("key"), pages[html].alias("text")), None, rows, 6_000_000, 60_000)
    parsed = [(b, y) for b, y in ((b, weak_labels(b)) for b in (blocks(t) for _, _, t in got)) if b and y is not None and len(b) <= 200]
    if not parsed:
        page = blocks("<body><nav><a href=x>home</a></nav><article><h1>head</h1><p>first words of a text</p><p>more</p></article><footer>end</footer></body>")
        parsed = [(page, weak_labels(page))]
    rnd = np.random.default_rng(8)
    texts = [b.text for page, _ in parsed for b in page]
    examples = [(vectors(b), y) for b, y in parsed]
    for page, y in parsed:
        for _ in range(variants if len(parsed) > 50 else 200 // len(parsed)):
            b, z = varied(page, y, texts, rnd)
            examples.append((vectors(b), z))
    model = Labeller()
    model.train(examples)
    return model


def extract(pages: DataFrame, model: Labeller, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page: the blocks labelled as article, in page order, joined by one newline.

    Whole pages are read. Null and empty pages, and pages without an article block, have an empty text. Null keys and
    URLs and repeated rows are kept. No rows give no rows.
    """
    fields = [T.StructField(c, pages.schema[n].dataType) for c, n in (("key", key), ("url", url))]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    sent = pages.sparkSession.sparkContext.broadcast(model.p)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Labeller()
        reader.p = sent.value
        for batch in batches:
            texts = []
            for at in range(0, batch.num_rows, 256):
                read = [blocks(t) for t in batch.column(2).slice(at, 256).to_pylist()]
                labels = reader.label([vectors(b) for b in read])
                texts += ["\n".join(b.text for b, y in zip(page, own) if y) for page, own in zip(read, labels)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["key", "url", "text", "n_chars"])

    found = pages.select(pages[key].alias("key"), pages[url].alias("url"), pages[html].alias("html")).mapInArrow(work, schema)
    return found.select(F.col("key").alias(key), F.col("url").alias(url), "text", "n_chars")
