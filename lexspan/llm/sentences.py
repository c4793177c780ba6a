"""Problem 1: sentence units of every text with their places.

Spaced scripts: every run of terminators is a node of a lattice with two readings, the end of a sentence and a mark inside it
(of an abbreviation, a number, an address, an ellipsis, a quotation). Each reading has a cost by the words on both sides and the open quotations;
steps from one node to the next cost more where a unit would be a fragment or leave a bracket open, and less along chains of abbreviations. The
cheapest path through a block's nodes gives its sentences. Scripts without spaces between words: the chunks between gaps
are cut into words by the cheapest path through a lattice of dictionary words, and a gap is an end by the sum of what the
words around it say: final particles and verb endings before it, opening words after it, words that bind on either side.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexspan.llm.layout import MARKER, blocks
from lexspan.sources.tables import table

# Abbreviations after which a sentence goes on, without their last dot, in lower case.
OPEN_ABBREVIATIONS = set(
    "e.g i.e pvt dr mr mrs ms prof sec art arts no nos nr approx reg para paras fig figs tab vol ch cl pt pp p st cf vs viz ca est incl excl dept ed eds al op cit gen hon rev jr sr sra srta messrs "
    "abs ziff bzw z.b z d.h d vgl evtl ggf inkl zzgl exkl hr fr str bspw s rn sog gem "
    "mme mlle m mm env ex chap pág págs pag núm num ud uds vd vds apdo dto cap inc.n inciso fls av avda tel n.º n "
    "ст п пп гл см напр т.е т.п т г гг руб коп ул д корп стр рис табл им".split()
)
# Abbreviations that may also be a sentence's last word.
CLOSE_ABBREVIATIONS = set(
    "etc a.m p.m inc corp ltd ltda co llc plc s.a s.l s.a.r.l s.a.s v e.v jr bros km cm mm kg min max usw u.a u.ä ff f uvw m.b.h s.p.a pcl d.c u.s u.k ecc и.т.д др пр тыс млн км กม ฯลฯ".split()
)
# Titles and names of places, months and days before a name or number, in lower case.
TITLES = set("lt gov gen col maj sgt capt cpl sen rep pres mt ft adm amb atty cmdr det insp supt hon rev fr sra dra drs ing lic mgr".split())
DATES = set("jan feb mar apr jun jul aug sep sept oct nov dec mon tue tues wed thu thur thurs fri sat sun janv févr avr juil déc ene abr ago dic fev mai set out dez okt".split())
# countries' abbreviations that are as often an attribute of the next word.
COUNTRIES = {"u.s", "u.k", "u.n", "e.u", "u.s.a"}
# Month names that follow a German ordinal.
MONTHS = set("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
# Words that open a sentence and are elsewhere written small, for texts on one line whose items lack terminators.
OPENING = set(
    "We You Our The These This If To In For From As Some Any No When Unless Where Please Your During After Before "
    "Wir Sie Unsere Unser Wer Die Der Das Diese Für Wenn Nach Bei Ihre "
    "Nous Vous Notre Nos Les Le La Ce Ces Si Quand Pour Selon Il Vos "
    "Usted Nuestros Nuestras Los Las El Estas Si Cuando Para Según Puede "
    "Você Nossos Nossas Os As O A Estas Se Quando Quem "
    "Мы Вы Наши Если Для При Когда Согласно Настоящие".split()
)
CANDIDATE = re.compile(r"""[.!?…。！？।॥؟]+(?:["”“»」』)\]]+[.!?…。！？]*)?""")
QUOTES = re.compile(r'["“”„«»「」『』]')
PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』"}
_FULL = "。！？।॥؟"
#: Longest quotation that is kept whole.
LONGEST_QUOTE = 600
_THAI = re.compile(r"[฀-๿]")
_BULLET = re.compile(r"(?<=\s)(?:[-*•]|\(([a-z0-9])\)|(\d{1,2})\.)\s+(?=[^\W_]|[\"“„«¿¡「<])")
_LEADING = re.compile(r"\s*(?:\((a)\)|(1)\.)\s")
_OPENER = re.compile(r"(?<=[\w\"”»);,] )(?:" + "|".join(sorted(OPENING)) + r")(?= )")


def _quotations(block: str) -> list[tuple[int, int]]:
    """(open, close) places of quotations."""
    out, opened, closers = [], -1, ""
    for m in QUOTES.finditer(block):
        c = m.group()
        if opened >= 0 and c in closers:
            if m.start() - opened <= LONGEST_QUOTE:
                out.append((opened, m.start()))
            opened = -1
        elif opened < 0 or m.start() - opened > LONGEST_QUOTE:
            closers = PAIRS.get(c, '"' if c == '"' else "")
            opened = m.start() if closers else -1
    return out


def _before(block: str, p: int) -> str:
    """The word before a place, of any length."""
    a = p
    while a and not block[a - 1].isspace() and block[a - 1] not in '([\"“„«<':
        a -= 1
    return block[a:p]


#: Costs of the readings of a node: far apart where the rules leave no doubt, near where the path may decide otherwise.
SURE, SOFT = 9.0, 1.0
#: Costs of steps: a unit of one word, an end within brackets, a chain of abbreviations.
FRAGMENT, BRACKET, CHAIN = 1.5, 0.75, -0.5


def _readings(block: str, m: re.Match, quotes: list[tuple[int, int]], thai: bool) -> tuple[float, float]:
    """The costs of reading a run of terminators as an end and as a mark inside a sentence."""
    p, q = m.span()
    if block[p] == "." and q == p + 1 and q < len(block) and block[q].isspace():
        word = _before(block, p)
        low = word.lower()
        follows = _WORD_AT.match(block, q + 1)
        nxt = follows.group() if follows else ""
        if word[:1].isupper() and low in TITLES and nxt[:1].isupper() and not any(a < p < b for a, b in quotes):
            return SURE, 0.0
        if word[:1].isalpha() and low in DATES and nxt[:1].isdigit() and (word[0].isupper() or block[:p].rstrip(word).rstrip()[-1:].isdigit()):
            return SURE, 0.0
        if low in COUNTRIES and nxt[:1].isupper() and nxt[1:2].islower():
            return (0.0, SOFT) if nxt in OPENING else (2 * SOFT, 0.0)
        if low in ("h", "g", "m", "l", "s", "t", "w") and word.islower() and nxt[:1].isupper() and block[: p - 1].rstrip()[-1:].isdigit() and not any(a < p < b for a, b in quotes):
            return 0.0, 2 * SOFT
        if low in OPEN_ABBREVIATIONS or len(word) == 1:
            return (0.0, SURE) if _ends(block, m, quotes, thai) else (2.5 * SOFT, 0.0)
        if low in CLOSE_ABBREVIATIONS:
            return (0.0, 2.5 * SOFT) if _ends(block, m, quotes, thai) else (SURE, 0.0)
    return (0.0, SURE) if _ends(block, m, quotes, thai) else (SURE, 0.0)


def _path(block: str, since: int, nodes: list[tuple[int, int, float, float]]) -> list[int]:
    """The ends on the cheapest path through a block's nodes (place, end, cost as end, cost as a mark inside).

    Of the unit that is open a path knows the words (two at most), the open brackets (three at most) and whether its last node was an
    abbreviation in doubt; paths alike in these differ in nothing but cost, so there are few at every node, however many nodes there are.
    """
    states: dict[tuple[int, int, bool], tuple[float, tuple | None]] = {(0, 0, False): (0.0, None)}
    last = since
    for p, q, end, inside in nodes:
        part = block[last:p]
        words, opened = len(part.split()), part.count("(") - part.count(")")
        last, soft = q, 0.0 < end < SURE
        new: dict[tuple[int, int, bool], tuple[float, tuple | None]] = {}
        for (had, depth, chained), (cost, ends) in states.items():
            now, open_now = min(2, had + words), max(0, min(3, depth + opened))
            options = []
            if end < SURE:
                options.append(((0, 0, False), cost + end + FRAGMENT * (now < 2) + BRACKET * (open_now > 0), (q, ends)))
            if inside < SURE:
                options.append(((now, open_now, soft), cost + inside + CHAIN * (soft and chained and words == 1), ends))
            for key, price, path in options:
                if key not in new or price < new[key][0]:
                    new[key] = (price, path)
        states = new
    ends, out = min(states.values(), key=lambda x: x[0])[1], []
    while ends:
        out.append(ends[0])
        ends = ends[1]
    return out[::-1]


def _ends(block: str, m: re.Match, quotes: list[tuple[int, int]], thai: bool) -> bool:
    """Which reading of a run of terminators its neighbours speak for: the end of a sentence or not."""
    p, q = m.span()
    mark = block[p]
    for a, b in quotes:
        if a < p and b >= q:
            return False
    size = len(block)
    after = block[q] if q < size else ""
    if mark in _FULL:
        # After a closing quotation the sentence goes on in scripts without capitals.
        return block[q - 1] in _FULL or after.isupper() or after.isspace() and block[q:].lstrip()[:1].isupper()
    r, k = after, q
    while r and r.isspace():
        k += 1
        r = block[k] if k < size else ""
    if not r:
        return False
    word = _before(block, p)
    if k == q:
        if mark == "…" or block[p:q] in ("..", "..."):
            return r.isupper() and word[-1:].islower()
        if r in "<|":
            return False
        if not (len(word) >= 2 and word[-2:].isalpha() and r.isalpha()) or any(x in word for x in "@/:."):
            return mark in "!?" and r.isalpha() and not r.islower() and word[-1:].isalpha() and "/" not in word
        follow = block[k + 1 : k + 2]
        if mark in "!?" and not r.islower():
            return True
        return r.isupper() and (follow.islower() or follow in " '’") and word[-1].islower()
    camel = r.islower() and block[k + 1 : k + 2].isupper()
    if r.islower() and not camel:
        return False
    if r in "–—-·|/&,;:)]":
        return bool(MARKER.match(block, k)) and r == "-" and (word[-1:].isalpha() and word.lower() not in CLOSE_ABBREVIATIONS)
    if mark in "!?" or mark == "…" or q - p >= 2 and block[p:q].startswith(".."):
        return mark != "…" or not _is_spaceless(r)
    if block[p + 1 : q]:
        return True
    low = word.lower()
    if "'" in low or "’" in low:
        low = re.split("['’]", low)[-1]
    caseless = r.isalpha() and not r.isupper() and not r.islower()
    if "ऀ" <= r <= "ॿ" or "ऀ" <= word[-1:] <= "ॿ":
        return False
    if thai and caseless:
        return low in ("กม", "ฯลฯ") and _opens(block, k) >= 2.0
    if low in OPEN_ABBREVIATIONS:
        # A name such as "No. Our" is rarer than "No. 5": a capital function word still opens a sentence.
        return low == "no" and not r.isdigit() and word == "no"
    if low in CLOSE_ABBREVIATIONS:
        if word == "inc" and r.isdigit():
            return False
        if low in ("v", "a") and not _PAIRED.search(block, max(0, p - 5), p):
            return False
        # In a sentence of capitals they tell nothing.
        if len(word) > 1 and word.isupper() and (nxt := _WORD_AT.match(block, k)) and len(nxt.group()) > 1 and nxt.group().isupper():
            return False
        return r.isupper() or camel or r in "\"“„«¿¡「" or (r.isdigit() and low not in ("ff", "f"))
    if len(word) == 1 and word.isalpha():
        return False if not _is_spaceless(word) else True
    if "." in word and not any(x in word for x in "@/") and all(len(x) <= 2 for x in word.split(".")) and word[:1].isalpha():
        return r.isupper() and word[:1].islower()
    if word.isdigit():
        if not block[: p - len(word)].strip():
            return False
        nxt = _WORD_AT.match(block, k)
        if len(word) <= 2 and nxt and nxt.group().lower() in MONTHS:
            return False
    return True


_WORD_AT = re.compile(r"\w+")
_PAIRED = re.compile(r"(?:\b[eu]\.|\.)\s?[VvAa]$", re.IGNORECASE)
_ALNUM = re.compile(r"[^\W_]")
_MENU = re.compile(r"\S\s*[|·»/]\s*\S+\s*[|·»/]\s|\S {3,}\S+ {3,}\S")


def _is_spaceless(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "฀" <= c <= "๿"


# Thai words for the lattice. Those of OPEN_TH open sentences, those of AFTER_TH do so in stories and letters, those of NAMED_TH follow a name that opens one.
OPEN_TH = "เรา คุณ ท่าน ผู้ใช้ ค่าบริการ กฎ กฎเรื่อง ข้อมูล เมื่อ เมื่อคุณ หาก ถ้า ตามข้อ บัญชี สำเนา คติ โปรด กรุณา การตัดสินใจ ข้อพิพาท เซิร์ฟเวอร์ รายชื่อ ดู บริษัท ข้อกำหนด คุกกี้ เวอร์ชัน ฉบับ รุ่น ลิขสิทธิ์ กฎเดิม ทั้งนี้ นอกจากนี้".split()
AFTER_TH = "ฉัน ดิฉัน ผม เขา เธอ พวกเขา พวกเรา พวกคุณ มัน วันนี้ พรุ่งนี้ เมื่อวาน เมื่อวานนี้ ตอนนี้ ต่อมา จากนั้น หลังจากนั้น ดังนั้น อย่างไรก็ตาม เพราะฉะนั้น นี่คือ นั่นคือ ขอบคุณ สวัสดี ขอโทษ ทำไม อะไร ใคร".split()
NAMED_TH = "ดูแล ไม่รับประกัน อาจ จะ เก็บ ไม่ ใช้ ขอ บันทึก".split()
#: Words that leave a sentence open before a gap or keep it open after one.
BIND_TH = "และ หรือ ของ ที่ ใน จาก เป็น กับ โดย เพื่อ ถึง ต่อ ต้อง ผ่าน แก่ ให้ ซึ่ง บน ตาม สำหรับ ว่า".split()
JOIN_TH = "ได้ วัน เดือน ปี แต้ม วรรค เริ่ม เท่าที่จำเป็น สมาชิก ผู้ให้บริการ บุคคลภายนอก".split()
#: Particles that close a sentence.
CLOSE_TH = "ครับ ค่ะ คะ นะ นะคะ นะครับ จ้ะ จ้า จ๊ะ ล่ะ สิ ซิ เถอะ ฮะ ขอรับ หรอก".split()
#: Everyday words, so that the ones above are not found inside of them.
WORDS_TH = "คน บ้าน น้ำ อาหาร ผลไม้ ตลาด เพื่อน อากาศ ดี ดีมาก มาก น้อย ใหญ่ เล็ก ใหม่ เก่า ไป มา กลับ กลับบ้าน ซื้อ ขาย กิน ดื่ม นอน ทำ ทำงาน เรียน โรงเรียน หนังสือ อ่าน เขียน พูด ฟัง รู้ รู้จัก คิด รัก ชอบ อยาก มี ไม่มี อยู่ แล้ว ยัง กำลัง เคย เวลา ชั่วโมง นาที ปีนี้ เช้า เย็น คืน ฝน ร้อน หนาว รถ ถนน เมือง ประเทศ ไทย ภาษา เงิน บาท ราคา สิทธิ ความ การ นโยบาย บริการ ความเป็นส่วนตัว เว็บไซต์ อีเมล ลูกค้า สินค้า คะแนน ขณะ คณะ ชนะ ธนาคาร สถานะ ลักษณะ เฉพาะ และเวลา".split()
COMPANY = {"co.", "pcl", "ltd.", "inc.", "corp."}
# Japanese and Chinese words and endings that close a sentence, open one, or bind.
CLOSE_CJK = "です ます ました でした ません ませんでした でしょう ましょう ください だった である ている ていた なかった しない した する だ か ね よ 吗 呢 吧 啊 呀 了".split()
OPEN_CJK = "私 私たち 当社 お客様 彼 彼女 今日 昨日 明日 また しかし そして ただし なお さらに この その これ それ もし 我们 我 你 您 他 她 他们 本 如果 但是 但 因此 此外 今天 明天 昨天 请 这 那".split()
BIND_CJK = "は が を に へ と で の も や から まで より 和 或 的 与 及 在 对 把 被 以及".split()
#: Of those that bind, the ones that cannot be the beginning of another word after a gap.
KEEP_CJK = "和 或 的 与 及 以及 まで から より".split()
_MARKS_TH = frozenset("ะัาำิีึืฺุูๅ็่้๊๋์ํ๎ๆฯ")
_LEAD_TH = frozenset("เแโใไ")
#: Cost of a word on a path, and of each character outside all words.
WORD_COST, STRAY_COST = 1.0, 1.2


def _automaton(words: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for w in words:
        out.add_word(w, len(w))
    out.make_automaton()
    return out


_WORDS_TH = _automaton(sorted({*OPEN_TH, *AFTER_TH, *NAMED_TH, *JOIN_TH, *BIND_TH, *CLOSE_TH, *WORDS_TH}))
_WORDS_CJK = _automaton(sorted({*CLOSE_CJK, *OPEN_CJK, *BIND_CJK}))


def lattice_words(chunk: str, words: ahocorasick.Automaton) -> tuple[str, str]:
    """The first and the last word on the cheapest path through the lattice of dictionary words over a whole chunk.

    An empty string stands for a stretch outside all words. Thai words begin and end where a character may: not before a
    mark, not after a leading vowel.
    """
    size = len(chunk)
    # Nodes in order of place; `least` is the running minimum of cost less STRAY_COST * place, `by` the node that has it.
    places, costs, least, by = [0], [0.0], [0.0], [0]
    first, last = [""], [""]
    for end, length in words.iter(chunk):
        to, start = end + 1, end + 1 - length
        if to < size and chunk[to] in _MARKS_TH or chunk[start] in _MARKS_TH or chunk[end] in _LEAD_TH or start and chunk[start - 1] in _LEAD_TH:
            continue
        k = by[bisect_right(places, start) - 1]
        cost = costs[k] + STRAY_COST * (start - places[k]) + WORD_COST
        if places[-1] == to:
            if cost >= costs[-1]:
                continue
            for x in (places, costs, least, by, first, last):
                x.pop()
        elif cost >= STRAY_COST * to + least[-1]:
            continue
        word = chunk[start:to]
        places.append(to)
        costs.append(cost)
        first.append(word if start == 0 else first[k] if k else "")
        last.append(word)
        low = cost - STRAY_COST * to
        better = low <= least[-1]
        least.append(low if better else least[-1])
        by.append(len(places) - 1 if better else by[-1])
    k = by[-1]
    return first[k], last[k] if places[k] == size else ""


_OPEN_TH, _AFTER_TH, _NAMED_TH, _BIND_TH, _CLOSE_TH = map(frozenset, (OPEN_TH, AFTER_TH, NAMED_TH, BIND_TH, CLOSE_TH))
_CLOSE_CJK, _OPEN_CJK, _BIND_CJK = map(frozenset, (CLOSE_CJK, OPEN_CJK, BIND_CJK))
_CHUNK = re.compile(r"\S+")
_CJK = r"[\u3040-\u30ff\u3400-\u9fff]"
_GAP_CJK = re.compile(rf"(?<={_CJK})[ \u3000]+(?={_CJK})")
_EDGE_CACHE: dict[str, tuple[str, str]] = {}


def _edge_words(chunk: str, words: ahocorasick.Automaton) -> tuple[str, str]:
    """The first and last dictionary words of a chunk; short chunks are remembered."""
    if len(chunk) > 80:
        return lattice_words(chunk, words)
    known = _EDGE_CACHE.get(chunk)
    if known is None:
        if len(_EDGE_CACHE) > 50_000:
            _EDGE_CACHE.clear()
        known = _EDGE_CACHE[chunk] = lattice_words(chunk, words)
    return known


def _opens(block: str, at: int) -> float:
    """How much speaks for a sentence that opens at a place of a Thai block."""
    chunk = _CHUNK.match(block, at)
    if not chunk:
        return 0.0
    c = chunk.group()
    if _THAI.match(c):
        word = _edge_words(c, _WORDS_TH)[0]
        return 2.0 if word in _OPEN_TH or word in _AFTER_TH else 0.0
    # A name opens a sentence if a verb without another subject follows it.
    if c[:1].isupper():
        k = chunk.end()
        while (nxt := _CHUNK.search(block, k)) and not _THAI.match(nxt.group()):
            if not nxt.group()[:1].isupper():
                return 0.0
            k = nxt.end()
        return 2.0 if nxt and _edge_words(nxt.group(), _WORDS_TH)[0] in _NAMED_TH else 0.0
    return 0.0


def _gaps_th(block: str, quotes: list[tuple[int, int]]) -> list[int]:
    """Places where sentences open after gaps of a Thai block: those for which the words around speak by two or more."""
    out, last = [], ""
    for m in _CHUNK.finditer(block):
        k, chunk, before = m.start(), m.group(), last
        last = chunk
        if not before or before[-1] in ",:;–-(/|·" or any(a < k <= b for a, b in quotes):
            continue
        if before[0].isascii() and before[0].isalpha() and chunk[0].isascii() and before.lower() not in COMPANY:
            continue
        said = _opens(block, k)
        if _THAI.match(before) and before not in _OPEN_TH:
            end = _edge_words(before, _WORDS_TH)[1] if said or before.endswith(CLOSE_TH_ENDS) else ""
            if end in _CLOSE_TH and not _BIND_FIRST.match(chunk):
                said += 2.0
            elif end in _BIND_TH and chunk[0].isascii():
                said -= 2.0
        elif before in _OPEN_TH:
            said -= 2.0
        if said >= 2.0:
            out.append(k)
    return out


CLOSE_TH_ENDS = tuple(CLOSE_TH)
_BIND_FIRST = re.compile("|".join(sorted(BIND_TH, key=len, reverse=True)) + r"|[^\w]")


def _gaps_cjk(block: str, quotes: list[tuple[int, int]]) -> list[int]:
    """Places where sentences open after gaps between Chinese or Japanese characters.

    An ending that closes a sentence speaks by two, an opening word by one, an ideographic space by one; words that bind speak by two against it.
    """
    out, since = [], 0
    for m in _GAP_CJK.finditer(block):
        before, k = block[since : m.start()], m.end()
        since = k
        after = _GAP_CJK.search(block, k)
        tail = re.split(r"\s", before)[-1]
        close = _edge_words(tail, _WORDS_CJK)[1]
        opening = _edge_words(re.split(r"\s", block[k : after.start() if after else len(block)], maxsplit=1)[0], _WORDS_CJK)[0]
        said = 2.0 * (close in _CLOSE_CJK) - 2.0 * (close in _BIND_CJK) + (opening in _OPEN_CJK) - 2.0 * (opening in KEEP_CJK) + ("\u3000" in m.group())
        if said >= 3.0 and len(tail) > 2 and not any(a < k <= b for a, b in quotes):
            out.append(k)
    return out


def _items(block: str) -> list[int]:
    """Places of list items in a text on one line."""
    out, letter, number = [], "", 0
    first = _LEADING.match(block)
    if first:
        letter, number = first.group(1) or "", int(first.group(2) or 0)
    for m in _BULLET.finditer(block):
        if m.group(1):
            want = "a" if not letter else chr(ord(letter) + 1)
            if m.group(1) not in (want, "a"):
                continue
            letter = m.group(1)
        elif m.group(2):
            n = int(m.group(2))
            if n not in (number + 1, 1):
                continue
            if n == 1 and " 2. " not in block[m.end() :]:
                continue
            number = n
        elif block[m.end() : m.end() + 1].islower() and not block[m.end() + 1 : m.end() + 2].isupper():
            continue
        out.append(m.start())
    return out


def unit_starts(text: str) -> list[int]:
    """Places of the first characters of a text's sentence units, in order."""
    out: list[int] = []
    body = text.strip()
    one_line = "\n" not in body and "</" not in body
    for at, block in blocks(text):
        size = len(block)
        lead = size - len(block.lstrip())
        if lead == size:
            continue
        out.append(at + lead)
        if size - lead < 4:
            continue
        thai = _THAI.search(block) is not None
        quotes = _quotations(block) if QUOTES.search(block) else []
        found: list[int] = []
        marker = MARKER.match(block, lead)
        since = marker.end() if marker else lead
        nodes, doubt = [], False
        for m in CANDIDATE.finditer(block, since):
            if m.end() < size:
                end, inside = _readings(block, m, quotes, thai)
                doubt = doubt or end != SURE and inside != SURE
                nodes.append((m.start(), m.end(), end, inside))
        # Without a node in doubt there is one path.
        for k in _path(block, since, nodes) if doubt else [q for _, q, end, _ in nodes if not end]:
            while k < size and block[k].isspace():
                k += 1
            if k < size and (block[k].isalnum() or _ALNUM.search(block, k)):
                found.append(k)
        if one_line:
            items = _items(block)
            if items or marker:
                found += items
                stops = sorted({*found, size})
                for i in [*([lead] if marker else []), *items]:
                    end = next(s for s in stops if s > i)
                    o = _OPENER.search(block, i + 12, end)
                    if o and not any(a < o.start() < b for a, b in quotes):
                        found.append(o.start())
        if thai and " " in block[lead:] and not _MENU.search(block):
            found += _gaps_th(block, quotes)
        if not block.isascii() and _GAP_CJK.search(block) and not _MENU.search(block):
            found += _gaps_cjk(block, quotes)
        if found:
            out += [at + k for k in sorted(set(found)) if k > lead and not (marker and k <= marker.end())]
    return out


def sentence_units(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, char_start, char_end) of every sentence unit of every text, in code points; ends are exclusive.

    Null, empty and blank texts, and texts of nothing but tags, have no units; null ids and repeated rows come out as they
    went in. One narrow pass without a shuffle; texts of any length are read once from start to end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                ids, starts, ends = [], [], []
                for i, text in zip(batch.column(0).slice(lo, 256).to_pylist(), batch.column(1).slice(lo, 256).to_pylist()):
                    if not text:
                        continue
                    s = unit_starts(text)
                    ids += [i] * len(s)
                    starts += s
                    ends += [*s[1:], len(text)][: len(s)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[id_column, "char_start", "char_end"])

    schema = f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, char_start int, char_end int"
    return docs.select(id_column, text_column).mapInArrow(run, schema)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The start of every sentence unit."""
    return sentence_units(table(spark, sf_dir, "documents")).select("doc_id", "char_start")


QUERIES = {"p1_found": p1_found}
SQL: dict[str, str] = {}
