"""Sentence units across languages and scripts.

A text is cut at blank lines into blocks; log lines and list items are units of
their own. Within a block the candidate ends are the nodes of a lattice:

* Spaced scripts: terminator lattices. Every run of final marks with the closers
  after it is a node. Nodes that would cut a quotation or a parenthesis do not
  exist; a node costs according to what stands before it (abbreviation, initial,
  ordinal) and what follows (case, opening mark), an edge if it makes a unit of
  punctuation only. The cheapest path from the start to the end of the block is its
  segmentation, found in one pass.
* Spaceless scripts: the run after a closed quotation and the whole runs around a white
  space gap are segmented by a dictionary word lattice; the gap, a node of the path
  like the others (none within a quotation or a parenthesis), is then classified through
  final particles before it and opening words after it. The white space itself counts by
  script: in Thai for more than the classes can take away, as the project's definition
  ends a sentence between two Thai letters; in Chinese and Japanese for nothing.

The dictionary has the words listed here, and the words of spaceless scripts of a
public vocabulary file, whose ranks give their costs. Outside of words the lattice
goes by grapheme clusters.

Rows are independent: the operator is one Arrow-batched pass without a shuffle.
Zero-width characters are looked through and never stand at the edge of a unit.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.encoding import TOKENIZERS

# ---- fixed values: marks -----------------------------------------------------------
FINAL = ".!?…؟۔。！？।॥။។៕።"
HARD = "؟۔。！？।॥။។៕።"  # ends a sentence whatever the case of the next letter
CJK_FINAL = "。！？"
PAIRS = {"“": "”", "„": "“", "«": "»", "‹": "›", "‘": "’", "「": "」", "『": "』", "《": "》", "（": "）", "(": ")", "[": "]", "{": "}", "【": "】"}
CLOSERS = "”“»›」』》）)]}】\"’'"
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
BULLETS = "-•*‣◦▪–"

# ---- fixed values: abbreviations, in lower case without the last period ----------
#: Before a name or a number: never the end of a sentence.
TITLES = frozenset(
    "dr prof mr mrs ms messrs st sr sra srta dra dres ing lic hr mme mlle mgr gen col capt lt sgt rev hon gov pres rep sen no nr nos fig figs tab tabs sec secs ch chap art vol pp pg cf vgl vs approx aprox est std dev ed eds e.g i.e z.b d.h u.a p.ex p.ej resp bzw ca rd abs abb ziff kap bd ee rr pág págs pag núm art env ex ej см стр табл рис гл ок ул им проф акад т.е т.к т.н напр डॉ रु श्री प्रो सं अ.प د أ ص".split()
)
#: Before a number no end; before a capital letter the end of a sentence.
NUMBERED = frozenset("jan feb mar apr jun jul aug sep sept oct nov dec min max col г гг тыс млн млрд руб мин сек ч п etc usw inc ltd co corp bros al a.m p.m ee.uu u.s e.u u.k".split())
TIMES = frozenset(("a.m", "p.m"))
#: Words after which a short number with a period is an ordinal.
ORDINAL_AFTER = frozenset("der die das dem den des im am vom zum zur beim bis ab seit jeder jede jedes jeden ihr ihre sein seine einem einer den 1".split())

# ---- fixed values: lexicon of the word lattices ---------------------------------
#: After a closed quotation, these continue the sentence.
CONTINUERS = frozenset("と という といった との って とは とも と言い と言う と言った と尋ねた と書いた と述べた は が を に の も で へ 说 说道 写道 问 问道 答 表示 指出 强调 认为 这样 这样写道 由 的 是 和 与 随后 并 等 一文 中 所 为 起草 值班员 यह ऐसा ऐसी इस यही कहकर बोला लिखा कहा ใน โดย เขียน กล่าว".split())
OPENERS = frozenset("しかし また そして さらに ただし なお 但是 然而 此外 另外 因此 同时 所以 โปรด ราคา พบ ทีมงาน เรา ไม่มี วงเงิน ข้อมูล แบบจำลอง ผู้ หัวหน้า ฝ่าย ความ".split())
FINALS = frozenset("です ます でした ました だ である か よ ね 了 吗 呢 吧 啊 ครับ ค่ะ คะ แล้ว ทันที เอง เดิม ทุกครั้ง ตลาด".split())
#: Lao, Khmer and Burmese: words that go on with a sentence, that open one, and final particles.
LATER_CONTINUERS = frozenset("ແລະ ຫຼື ທີ່ ວ່າ ກັບ ໃນ ຂອງ ເພື່ອ និង ឬ ដែល ថា នៅ របស់ ដើម្បី ដោយ နှင့် သို့မဟုတ် ဟု ကို တွင် မှ".split())
LATER_OPENERS = frozenset("ແຕ່ ດັ່ງນັ້ນ ນອກຈາກນັ້ນ ຫຼັງຈາກນັ້ນ ພວກເຮົາ ຂ້ອຍ ລາວ ມັນ ທ່ານ ກະລຸນາ ເມື່ອ ຖ້າ ຕອນນີ້ ມື້ນີ້ ມື້ວານນີ້ ប៉ុន្តែ ដូច្នេះ លើសពីនេះ បន្ទាប់មក យើង ខ្ញុំ គាត់ ពួកគេ សូម ប្រសិនបើ ពេលដែល ឥឡូវនេះ ថ្ងៃនេះ ម្សិលមិញ သို့သော် ထို့ကြောင့် ထို့နောက် ကျွန်တော် ကျွန်ုပ် သူ ယခု ယနေ့ မနေ့က အကယ်၍".split())
LATER_FINALS = frozenset("ແລ້ວ ເດີ້ ບໍ ເນາະ ດອກ ហើយ ទេ ផង រួច တယ် ပါတယ် ပြီ မယ် လား ဘူး ပါသည်".split())
GAP_FINALS, GAP_OPENERS, GAP_CONTINUERS = FINALS | LATER_FINALS, OPENERS | LATER_OPENERS, CONTINUERS | LATER_CONTINUERS
#: Inflected words of the vocabulary end with a final particle; the Japanese ones of one letter also end other words.
ENDINGS = tuple(sorted(w for w in GAP_FINALS if len(w) > 1 or w in "了吗呢吧啊"))
#: Vocabulary file, in the folder of the tokenizers, whose words of spaceless scripts join the dictionary.
WORDS = "byte_bpe_multi_50k.tiktoken"
_SPACELESS = regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Han}\p{Hiragana}\p{Katakana}ー]{2,}")
_CLUSTER = regex.compile(r"\X")
_CONTENT = regex.compile(r"[^\p{P}\p{Z}\p{C}\s]")
#: Cost of a unit of punctuation only.
FRAGMENT = 20
LISTED = CONTINUERS | OPENERS | FINALS | LATER_CONTINUERS | LATER_OPENERS | LATER_FINALS


@lru_cache(maxsize=4)
def dictionary(path: str | None = None) -> dict[str, float]:
    """Word -> cost: 1 for the words listed here, up to 2 by rank for those of a vocabulary file (none if it is not there)."""
    costs: dict[str, float] = {}
    if path and os.path.exists(path):
        with open(path, "rb") as f:
            for line in f:
                piece, rank = line.split()
                word = base64.b64decode(piece).decode("utf-8", "ignore").strip()
                if _SPACELESS.fullmatch(word):
                    costs.setdefault(word, 1 + int(rank) / 65536)
    return costs | dict.fromkeys(LISTED, 1.0)

_LINE = regex.compile(r"[^\r\n\v\f\x85\u2028\u2029]*(?:\r\n|[\r\n\v\f\x85\u2028\u2029]|$)")
_LOG = regex.compile(r"\s*\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d)?\S*\s+[A-Z]{3,}\b")
_MARK = regex.compile(rf"\s*(?:(\d{{1,3}})[.)]|([{regex.escape(BULLETS)}]|\([a-z0-9]{{1,3}}\)))(?=\s)")
#: Periods inside a number, a name or a file name are no nodes.
_NODE = regex.compile(rf"(?![.…]+[\p{{Ll}}\p{{Nd}}_])[{FINAL}]+(?:\s?[»›](?!\w)|[{regex.escape(CLOSERS)}])*")
_SCRIPTS = r"\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Han}\p{Hiragana}\p{Katakana}ー\u3099\u309a"
#: White space between two letters of scripts without spaces; no sentence begins with a sign of repetition (ๆ, ໆ, ៗ).
_GAP = regex.compile(rf"(?V1)(?<=[[{_SCRIPTS}]&&[\p{{L}}\p{{M}}]])\s+(?=[[{_SCRIPTS}]&&[\p{{Lo}}\p{{M}}]])")
_RUN = regex.compile(rf"[{_SCRIPTS}]+")
_RUN_BEFORE = regex.compile(rf"(?r)[{_SCRIPTS}]+")
_THAI_LETTER = regex.compile(r"(?V1)[\p{Thai}&&[\p{Lo}\p{M}]--[ฯ]]")
_LATER = regex.compile(r"[\p{Lao}\p{Khmer}\p{Myanmar}ฯๆ]")
_PAIRED = regex.compile(r"[“”„«»‹›「」『』《》（）()\[\]【】\"]")
_FIRST_WORD = regex.compile(r"\w+")
_INITIAL = regex.compile(r"\w(?:\.\s|\s)")
_MARKS_ONLY = regex.compile(rf"[{FINAL}]+[^\S\n]?")
_WORD = regex.compile(r"(\w+)\W*$")
_GLUED = regex.compile(rf"(?<=[\w\p{{M}}]{{3}})[{FINAL}]+[{regex.escape(CLOSERS)}]*(?=\w)")  # a sentence end without white space
_STRIP = "“„«‹‘「『《（([{\"'—–-¿¡,;:”»’"


class Lattice:
    """Word lattices over one dictionary."""

    def __init__(self, costs: dict[str, float] | None = None):
        self.costs = dictionary() if costs is None else costs
        self.longest = max(map(len, self.costs))
        lengths: dict[str, set[int]] = {}
        for word in self.costs:
            lengths.setdefault(word[-1], set()).add(len(word))
        self.lengths = {last: sorted(n) for last, n in lengths.items()}
        self.known: dict[str, tuple[str, ...]] = {}

    def words(self, run: str) -> tuple[str, ...]:
        """Cheapest segmentation of a spaceless run: known words by their costs, other grapheme clusters 3 each."""
        if run in self.known:
            return self.known[run]
        at = {0: 0}  # where clusters begin: no word begins or ends within one
        for m in _CLUSTER.finditer(run):
            at[m.end()] = m.start()
        best: dict[int, tuple[float, int]] = {0: (0.0, 0)}
        for end in list(at)[1:]:
            options = [(best[at[end]][0] + 3, at[end])]
            options += [(best[end - n][0] + self.costs[run[end - n : end]], end - n) for n in self.lengths.get(run[end - 1], ()) if end - n in best and run[end - n : end] in self.costs]
            best[end] = min(options)
        words, end = [], len(run)
        while end:
            start = best[end][1]
            words.append(run[start:end])
            end = start
        found = tuple(reversed(words))
        if len(run) <= 64:
            if len(self.known) > 16384:
                self.known.clear()
            self.known[run] = found
        return found

    def gap_score(self, before: str, after: str) -> int:
        """How much a gap between two spaceless runs looks like a sentence boundary (above 1: yes)."""
        last, first = self.words(unicodedata.normalize("NFC", before))[-1], self.words(unicodedata.normalize("NFC", after))[0]
        score = min(_white(before[-1]), _white(after[0]))
        score += (last in GAP_FINALS or last.endswith(ENDINGS)) + (first in GAP_OPENERS)
        return score - 2 * (first in GAP_CONTINUERS)

    def continues(self, after: str) -> bool:
        """Whether the run after a closed quotation goes on with its sentence, by its opening word."""
        words = self.words(unicodedata.normalize("NFC", after))
        if not words or words[0] in OPENERS:
            return False
        return words[0] in CONTINUERS or not after[0].isspace()


def _script(ch: str) -> str:
    o = ord(ch)
    if 0x0E00 <= o <= 0x0E7F:
        return "thai"
    if 0x3040 <= o <= 0x30FF or 0x3400 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF or 0xFF66 <= o <= 0xFF9F or 0x20000 <= o <= 0x2FFFF:
        return "cjk"
    if ch.isalpha():
        return "cased" if ch.lower() != ch.upper() else "caseless"
    return "caseless" if unicodedata.category(ch)[0] == "M" and o >= 0x0590 else ""


def _white(ch: str) -> int:
    """How much white space beside this letter counts for the end of a sentence."""
    if _THAI_LETTER.match(ch):
        return 4  # the project's definition: more than a continuing word takes away
    return 1 if _LATER.match(ch) else 0  # Chinese and Japanese sentences end with marks


def _inside(block: str) -> list[tuple[int, int]]:
    """Matched quotations and parentheses as (opening, closing) positions."""
    found, stack, wanted = [], [], Counter()
    for m in _PAIRED.finditer(block):
        ch, at = m.group(), m.start()
        if wanted[ch]:
            opened, closer = -1, ""
            while closer != ch:
                opened, closer = stack.pop()
                wanted[closer] -= 1
            found.append((opened, at))
        elif ch in PAIRS or ch == '"':
            stack.append((at, PAIRS.get(ch, '"')))
            wanted[PAIRS.get(ch, '"')] += 1
    return found


def _before(block: str, at: int) -> tuple[str, str]:
    """The token that ends at ``at`` (exclusive) and the one before it."""
    parts = block[max(0, at - 80) : at].split()
    if not parts or block[at - 1].isspace():
        return "", parts[-1] if parts else ""
    token, prior = parts[-1], parts[-2] if len(parts) > 1 else ""
    if any(c in FINAL for c in token) and len(glued := _GLUED.split(token)) > 1:
        return glued[-1], glued[-2]
    if prior and not prior[-1].isalnum() or any(c in FINAL for c in prior):
        m = _WORD.search(prior)
        prior = m.group(1) if m else ""
    return token, prior


def _cost(block: str, m: regex.Match, quoted: bool, lattice: Lattice) -> int:
    """Cost of ending a sentence at a node: below 0 an end, above 0 none."""
    marks = m.group()
    at, end = m.start(), m.end()
    rest = block[end : end + 48]
    tail = rest.lstrip()
    if not tail:
        return -9
    spaced = rest[0].isspace()
    nxt = tail[0]
    final = marks.rstrip(CLOSERS + " \u00a0\u202f")
    look = tail
    while look and (look[0] in "—–-" or look[0] in ZERO_WIDTH):  # dialogue dash: look at what is said
        look = look[1:].lstrip()
    if nxt in ",;:،؛、，；：":
        return 9
    kind = _script(look[0]) if look else ""
    previous = next((c for c in reversed(block[max(0, at - 12) : at]) if c.isalpha()), "")
    caseless_before = bool(previous) and _script(previous) != "cased"
    hard = any(c in HARD for c in final)
    if quoted:
        if kind == "cased":
            return 9 if look[0].islower() and not (hard and spaced and caseless_before) else -5
        if kind in ("cjk", "caseless", "thai"):
            after = rest if kind == "cjk" else tail
            run = _RUN.match(block, end + len(rest) - len(after))
            return 9 if lattice.continues(run.group() if run else after[: 2 * lattice.longest]) and not (kind == "caseless" and "।" not in final) else -5
        return -5 if look and (look[0] in PAIRS or look[0] in '"¿¡' or spaced) else 9
    if hard and final[-1] not in ".…":
        return -9
    dots = final.strip("!?")
    if final in (".", "…", "...") or not dots.strip(".…"):
        if not spaced and nxt not in "“„«\"¿¡(—「『《":
            # white space may be lacking before a capitalised word
            if kind != "cased" and final[-1] != "…" and kind in ("caseless", "thai") and previous and _script(previous) == kind:
                token, _ = _before(block, at)
                return -5 if len(token.strip(_STRIP)) > 2 else 9
            if not (kind == "cased" and look[0].isupper()):
                return 9
            word = _FIRST_WORD.match(look)
            token, prior = _before(block, at)
            bare = unicodedata.normalize("NFC", token.strip(_STRIP)).lower()
            if bare in TIMES:
                return -3 if len(word.group()) > 1 else 9
            if final[0] == "." and len(final) == 1 and (bare in TITLES or len(bare) == 1 and bare.isalpha() or "." in bare and len(bare.replace(".", "")) <= 3 and bare.replace(".", "").isalpha()):
                return 9
            if len(word.group()) == 1 and not _INITIAL.match(look):
                return 9
            return -3
        if final[0] == "." and len(final) == 1:
            return _period(block, at, look, kind, caseless_before)
        # ellipsis, or a run of periods
        if kind == "cased" and look[0].islower() and not caseless_before:
            return 9
        return -5 if spaced or final[0] != "…" else 9
    # ! and ?, alone or mixed with other marks
    if kind == "cased" and look[0].islower() and not caseless_before:
        return 9
    return -5


def _period(block: str, at: int, look: str, kind: str, caseless_before: bool) -> int:
    """Cost of an end at a single period with white space or an opening mark after it."""
    token, prior = _before(block, at)
    bare = unicodedata.normalize("NFC", token.strip(_STRIP))
    low = bare.lower()
    number = bool(look) and look[0].isnumeric()
    if kind == "cased" and look[0].islower() and not (caseless_before and _script(bare[-1:] or " ") in ("cjk", "caseless", "thai")):
        return 9
    if low in TIMES:
        return 9 if number else -4
    if low in NUMBERED and low not in TITLES:
        return 9 if number else -3
    if low in TITLES:
        return 9
    if len(bare) == 1 and bare.isalpha():
        return 9
    if "." in bare and bare.replace(".", "").isalpha() and all(len(x) <= 2 for x in bare.split(".")):
        return 7
    if bare.isdecimal() and len(bare) <= 2 and kind == "cased" and prior.strip(_STRIP).lower() in ORDINAL_AFTER:
        return 7
    return -5


def _nodes(block: str, lattice: Lattice) -> list[tuple[int, int]]:
    """(end, cost) of the nodes of a block, in order: final marks with their closers, and gaps in spaceless scripts."""
    nodes, pairs, openings, around, ahead = [], None, set(), [], 0
    found = _NODE.finditer(block)
    if gaps := list(_GAP.finditer(block)):
        found = sorted([*found, *gaps], key=lambda m: m.start())
    for m in found:
        if pairs is None:
            pairs = sorted(_inside(block))
            openings = {a for a, _ in pairs}
        # pairs are nested: those around the node are a stack, the outermost first
        while ahead < len(pairs) and pairs[ahead][0] < m.start():
            while around and around[-1] < pairs[ahead][0]:
                around.pop()
            around.append(pairs[ahead][1])
            ahead += 1
        while around and around[-1] < m.start():
            around.pop()
        end, quoted = m.end(), bool(around)
        if quoted and around[0] >= end:
            continue  # such an edge would cut a quotation or a parenthesis
        if m.re is _GAP:
            before, after = _RUN_BEFORE.match(block, 0, m.start()), _RUN.match(block, m.end())
            nodes.append((m.start(), 3 - 2 * lattice.gap_score(before.group(), after.group())))
            continue
        if not quoted and any(c in CLOSERS for c in m.group()):
            # the closers belong to nothing that was opened before: one may open the next sentence
            while end > m.start() + 1 and block[end - 1] in CLOSERS and end - 1 in openings:
                end -= 1
            while end > m.start() + 1 and block[end - 1].isspace():
                end -= 1
            if end < m.end():
                m = _MARKS_ONLY.match(block, m.start(), end) or m
        nodes.append((m.end(), _cost(block, m, quoted, lattice)))
    return sorted(set(nodes))


def _path(block: str, lattice: Lattice) -> list[int]:
    """Ends of the sentences of a block: the cheapest path through the lattice of its nodes.

    An edge costs what its end node costs, and FRAGMENT if there is nothing but
    punctuation on it. Edges from before the last content of a stretch are
    no fragments, so two running minima are all that a node needs.
    """
    nodes = [(end, cost) for end, cost in _nodes(block, lattice) if cost < 0]
    if len(nodes) < 2 and not (nodes and not _CONTENT.search(block, nodes[0][0])):
        return [end for end, _ in nodes]
    nodes.append((len(block), 0))
    # totals of paths that end at a node, and the node before it; index 0 is the start of the block
    total, back = [0.0], [0]
    clear, near = 0, None  # best node before the content seen last, best node after it
    at = 0
    for end, cost in nodes:
        if _CONTENT.search(block, at, end):
            if near is not None and total[near] < total[clear]:
                clear = near
            near = None
        fragment = near is not None and total[near] + FRAGMENT < total[clear]
        # what follows the last node may be blank: then it is no unit
        if end == len(block) and near is not None and not block[at:end].strip():
            fragment = total[near] < total[clear]
            total.append(total[near if fragment else clear])
        else:
            total.append(cost + (total[near] + FRAGMENT if fragment else total[clear]))
        back.append(near if fragment else clear)
        new = len(total) - 1
        if near is None or total[new] <= total[near]:  # of equals the later, so marks stay with what they follow
            near = new
        at = end
    ends, node = [], back[-1]
    while node:
        ends.append(nodes[node - 1][0])
        node = back[node]
    return ends[::-1]


def _kind(bullet: str) -> str:
    """Kind of a bullet: a dash that also stands within sentences is its own, as are letters in parentheses."""
    return bullet if bullet == "–" else "(" if bullet[0] == "(" else "•"


def _blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole): blocks between blank lines; log lines and list items are whole units."""
    start, whole, item = None, False, None
    at = 0
    for m in _LINE.finditer(text):
        line = m.group()
        if not line:
            break
        at = m.start()
        if not line.strip():
            if start is not None:
                yield start, at, whole
            start, whole, item = None, False, None
            continue
        mark = _MARK.match(line)
        if mark and start is not None:
            # inside a block a mark must go on with the block's list: the next number, or a bullet of the kind
            went_on = item == int(mark.group(1)) - 1 if mark.group(1) else item == _kind(mark.group(2))
            # or the line before introduces it
            mark = mark if went_on or text[max(start, at - 80) : at].rstrip()[-1:] in (":", "：") else None
        log = _LOG.match(line)
        if log or mark:
            if start is not None:
                yield start, at, whole
            start, whole = at, True
            item = None if log else int(mark.group(1)) if mark.group(1) else _kind(mark.group(2))
        elif start is None:
            start = at
    if start is not None:
        yield start, len(text), whole


def _units(text: str, lattice: Lattice) -> Iterator[tuple[int, int]]:
    for start, end, whole in _blocks(text):
        block = text[start:end]
        cuts = [] if whole else _path(block, lattice)
        last = 0
        for cut in [*cuts, len(block)]:
            piece = block[last:cut]
            if body := piece.strip():
                lead = len(piece) - len(piece.lstrip())
                yield start + last + lead, start + last + lead + len(body)
            last = cut


def sentence_spans(text: str | None, lattice: Lattice | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit in code points; none for null and blank texts."""
    lattice = lattice or Lattice()
    if not text or not text.strip():
        return []
    if not any(z in text for z in ZERO_WIDTH):
        return list(_units(text, lattice))
    place = [i for i, c in enumerate(text) if c not in ZERO_WIDTH]
    return [(place[a], place[b - 1] + 1) for a, b in _units("".join(text[i] for i in place), lattice)]


def sentence_units(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None, words: str = WORDS) -> DataFrame:
    """(key, start_char, end_char) of every sentence unit of every row.

    Offsets count Unicode code points from 0; end_char is exclusive; a unit has no
    white space at its edges. Null, empty and white-space texts have no units. A row
    repeated is segmented as often as it occurs; other columns are ignored. The
    dictionary is read on the driver from ``words`` in the folder of the tokenizers.
    """
    kind = documents.schema[key].dataType
    costs = dictionary(os.path.join(folder or TOKENIZERS, words))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(costs)
        for batch in batches:
            rows: list[int] = []
            starts: list[int] = []
            ends: list[int] = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for a, b in sentence_spans(t, lattice):
                    rows.append(i)
                    starts.append(a)
                    ends.append(b)
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], [key, "start_char", "end_char"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType())])
    return documents.where(F.col(text).isNotNull()).select(key, text).mapInArrow(cut, schema)
