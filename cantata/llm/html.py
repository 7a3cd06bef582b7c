"""HTML extraction by line-block distribution."""
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_DROP = "script style noscript template svg nav header footer aside form button select textarea iframe head".split()
_BLOCK = "address article blockquote body br dd div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section table tbody td th thead tr ul".split()
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: Words of class, id and role names for what is not the article, and words that may stand beside them in such a name.
_NOISE = re.compile(r"ad|ads|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice\w*|popup|modal|newsletter|subscribe|menu|nav|navbar|navigation|breadcrumb\w*|sidebar|related|share|sharing|social|comment\w*|disqus|footer|header|masthead|widget|recommend\w*")
_BESIDE = set("""above area article articles aside bar below block body bottom box btn button buttons card cards center col column container content dropdown entry fixed foot form global google grid group hero
    holder icon icons inline inner item items layout left link links list main middle mobile more page panel post posts primary print region right rail root row secondary section side signup site slot
    small stories sticky story sub tabs thread title toolbar tools top unit user users view wrap wrapper zone""".split())
#: What a name is about when it has one of these beside "header": the head of the article itself.
_OWN = {"article", "entry", "post", "story"}
# A quote opens a value only behind "="; possessive, so that an unclosed one costs one scan.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Characters within one window from which a marked unit is an article to which doubtful ones give way.
SURGE = 400
#: Lines on each side of a line that its block takes in.
REACH = 2
#: What a mark says for a line, as a multiple of its characters, and the part of the page's highest block at which text surges: an unmarked stretch needs half of what the marked text has.
MARKED, PART = 10, 20
#: What a layout has or has not, as in with-sidebar: no name of the element itself.
_LAYOUT = re.compile(r"(?<![a-z])(?:with|without|has|no)[-_]\S*", re.I)
#: Elements whose ends part the page; more of them between two lines put these further apart.
_HOLDS = set("address article aside blockquote body details div dl fieldset figure footer form header html main nav ol section table ul".split())
_UNJUDGED = {"html", "body", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6"}
_RAW = {"script", "style", "textarea", "title"}


def _named(name: str) -> bool:
    """Whether a name as a whole, word by word, is one for noise: share-price is not, share-buttons is."""
    words = [w for w in re.split(r"[-_:.]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", name) if w and not w.isdigit()]
    words = [w.lower() for w in words if len(w) > 1]
    found = [w for w in words if _NOISE.fullmatch(w)]
    return bool(found) and all(w in _BESIDE for w in words if w not in found) and not (set(found) <= {"header", "footer"} and _OWN & set(words))


def is_noise(name: str, attrs: str) -> bool:
    """Whether a class, id or role names an element as no part of the article; headings and marks are not judged by them."""
    if name in _UNJUDGED:
        return False
    return any(_named(n) for a, b, c in _ATTR.findall(attrs) for n in _LAYOUT.sub(" ", a or b or c).split())


def lines(page: str):
    """Strip markup: (text, kept, unit, weight, gap) per block line, in page order, and the doubtful units.

    A unit is the innermost <article> or <main> around a line; unit 0 is what stands in none. A noise word
    around a unit does not discard it, but makes it doubtful; a dropped element around it does, and so does
    another <article>, within which it is what readers reply. The weight is the characters that are no
    link, the gap how many containers end, or begin, before the line.
    """
    out, buf, stack, at = [], [], [], 0
    noise, dropped, unit, units, doubtful = 0, 0, 0, [0], set()
    linked, links, ends, begins = 0, 0, 0, 0

    def flush():
        nonlocal linked, ends, begins
        t = " ".join("".join(buf).split())
        buf.clear()
        if t:
            out.append((t, not (noise or dropped), unit, max(0, len(t) - linked), max(ends, begins)))
            ends = begins = 0
        linked = 0

    def pop(n):
        nonlocal noise, dropped, unit, links, ends
        while len(stack) > n:
            name, bad, off, before = stack.pop()
            noise -= bad
            dropped -= off
            links -= name == "a"
            ends += name in _HOLDS
            if before is not None:
                noise, unit = before

    while at < len(page):
        m = _TOKEN.search(page, at)
        text = html.unescape(page[at:m.start() if m else len(page)])
        buf.append(text)
        if links:
            linked += len(" ".join(text.split()))
        if not m:
            break
        at = m.end()
        if not m.group(2):
            continue
        name, attrs = m.group(2).lower(), m.group(3)
        if m.group(1):
            if name in _BLOCK or name in _DROP:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
                if stack[i][0] in _BLOCK and name not in _BLOCK and name not in _DROP:
                    break
            continue
        if name in _BLOCK or name in _DROP:
            flush()
        if name in _RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "p" and stack and stack[-1][0] == "p":
            pop(len(stack) - 1)
        if name in _VOID or attrs.rstrip().endswith("/"):
            continue
        off = name in _DROP and not (name == "header" and unit)
        bad = is_noise(name, attrs)
        art = name in ("article", "main")
        off = off or (name == "article" and any(x[0] == "article" for x in stack))
        stack.append((name, bad, off, (noise, unit) if art else None))
        noise += bad
        dropped += off
        links += name == "a"
        begins += name in _HOLDS
        if art:
            units.append(0)
            if noise or unit in doubtful:
                doubtful.add(len(units) - 1)
            noise, unit = 0, len(units) - 1
    flush()
    return out, doubtful


def window_sums(lengths, window: int = 3):
    """Characters in the lines less than `window` away from each line."""
    return [sum(lengths[max(0, i - window + 1):i + window]) for i in range(len(lengths))]


def surge_and_dive(weights, gaps, sure=()):
    """(start, end) of the stretches of lines that surge, by sliding sums over lines and the gaps between them.

    A gap of n containers is n lines without text, so text that stands apart is not lifted by its
    neighbours. The text dives only at such gaps: lines side by side stay together, short ones too. A
    stretch surges where a line of it that has text of its own stands in a block of at least a PARTth of
    the page's highest one; the lines of `sure` surge however short they are. Lines of weight None are
    no text: they take no place in a block, and nothing lifts them.
    """
    spread, place = [], []
    for w, g in zip(weights, gaps):
        spread += [0] * min(g, 2 * REACH) * bool(spread)
        place.append(len(spread))
        spread += [] if w is None else [w]
    blocks = window_sums(spread, REACH + 1)
    level = max(blocks, default=0) / PART
    rises = lambda i: weights[i] is not None and (level == 0 or weights[i] > 0 and (blocks[place[i]] >= level or i in sure))
    edges = [i for i, g in enumerate(gaps) if g and i] + [len(weights)]
    start, out = 0, []
    for end in edges:
        if any(map(rises, range(start, end))):
            out.append((start, end))
        start = end
    return out


def tops(found):
    """The most characters within one window of each unit; windows do not cross units, so cards and comments in a row do not add up to an article."""
    sizes = {}
    for t, u in found:
        sizes.setdefault(u, []).append(len(t))
    return {u: max(window_sums(n)) for u, n in sizes.items()}


def without_doubt(found, doubtful):
    """Doubtful units give way to a marked article, and to an unmarked one that holds more text; else they count like others."""
    if not doubtful:
        return found
    sure = [(t, u) for t, u in found if u not in doubtful]
    top = tops(sure)
    if any(u and n >= SURGE for u, n in top.items()):
        return sure
    free, held = (sum(len(t) for t, u in found if test(u)) for test in (lambda u: not u, doubtful.__contains__))
    return sure if top.get(0, 0) >= SURGE and free > held else found


def main_text(page) -> str:
    """The article of one page, blocks joined by an empty line; null and empty pages give an empty text.

    Marks and names are evidence for the weights of lines: noise has none and is
    a stretch of its own, text within <article> or <main> counts MARKED times and
    surges by itself. Which lines stay is for the blocks of lines to say.
    """
    if not page:
        return ""
    found, doubtful = lines(page)
    sure = without_doubt([(t, u) for t, k, u, *_ in found if k], doubtful)
    left, rows, before = {u for _, u in sure}, [], True
    for t, k, u, w, gap in found:
        text = k and u in left
        rows.append((t, (max(w, 1) * MARKED if u else w) if text else None, max(gap, int(text != before)), u if text else 0))
        before = text
    texts, weights, gaps, units = zip(*rows) if rows else ((),) * 4
    kept = surge_and_dive(weights, gaps, {i for i, u in enumerate(units) if u})
    return "\n\n".join(t for s, e in kept for t in texts[s:e])


def _pages(batches):
    for b in batches:
        text = [main_text(h) for h in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Return page_id, url, text, n_chars per row; a page without html gives an empty text. Ids and urls, null too, pass through; rows that repeat stay."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return src.mapInArrow(_pages, "page_id long, url string, text string, n_chars long")
