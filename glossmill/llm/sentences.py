"""Sentence units of every text, in any language and script.

A pushdown automaton reads the marks of a text. A first stack holds the open levels of lists: each
line that goes on a list, or opens one of at least two items, starts a unit, with its number or
bullet. Within a unit a second stack holds the open quotations and brackets; no mark inside them ends
a sentence. Abbreviations are found in a trie read backwards from the
full stop; terminators are those of the script at hand. The units come out as offsets.

Rules are chosen by the characters around a mark, so a wrong or null language does no harm; the
language only settles ordinals ("18. Jahrhundert").

Defined results
---------------
* null, empty and blank texts, and texts of invisible marks only, have no units.
* places are code points; white space and invisible marks at the edges are not part of a unit.
* an id that comes more than once counts once; rows without id are left out.
* a quotation of any length that is closed in its paragraph is one; so is one that the end of a
  text without an end mark cuts off, as part of the last unit.
* any other opening mark is a mere sign: what stands open at the end of its paragraph, or when an outer
  bracket closes. Then the paragraph is read again from that mark on.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Abbreviations that never end a sentence.
TITLES = """
dr prof mr mrs ms st mt sr sra srta dra d jr rev hon gen col capt lt sgt sen rep gov
mme mlle mgr hr fr vgl bzw ca sog evtl inkl zzgl bkz cf approx vs viz al ej ee av avda
i.e e.g p.ej z.b d.h u.a c.-à-d κ κος κα δηλ π.χ κ.ά βλ دكتور د ص أ डॉ श्री पं г ул им т.е т.к
"""
#: Abbreviations that stand before a number.
BEFORE_NUMBERS = """
no nos nr núm n fig figs sec secs ch chap eq eqs art vol vols p pp pág págs s şek bd abb kap tab tel
jan feb mar apr jun jul aug sep sept oct nov dec cap lám стр рис гл σ σελ εικ
"""
#: Abbreviations that may end a sentence.
MAYBE = """
etc inc ltd co corp bros u.s u.k u.n s.a a.ş α.ε a.m p.m uu usw jh vb vd b.c a.d ph.d др пр
"""
#: Words after an ordinal number in German.
AFTER_ORDINALS = """
jahrhundert jahrhunderts jh januar februar märz april mai juni juli august september oktober november
dezember jahrestag kapitel klasse stock mal platz
"""
#: Words that open a German sentence, so that a number before them has ended one.
GERMAN_OPENERS = "der die das ein eine einer einem einen er sie es im in am an viele dr prof wo wer wie was und aber"
#: Verbs of speech after a speaker's name, by language.
SPEECH = {
    "en": "said asked replied answered wrote cried added shouted whispered explained called says asks",
    "de": "sagte fragte antwortete rief schrieb erklärte meinte flüsterte erwiderte",
    "fr": "dit demanda répondit cria écrivit ajouta murmura expliqua",
    "es": "dijo preguntó respondió gritó escribió añadió explicó contestó",
    "it": "disse chiese rispose gridò scrisse aggiunse spiegò",
    "pt": "disse perguntou respondeu gritou escreveu acrescentou explicou",
    "nl": "zei vroeg antwoordde riep schreef voegde",
    "tr": "dedi sordu yazdı bağırdı ekledi",
    "ru": "сказал сказала спросил спросила ответил ответила написал написала крикнул крикнула",
    "el": "είπε ρώτησε απάντησε έγραψε φώναξε",
}

ALWAYS = "。！？｡؟۔।॥።։᙮"
CASED = "!?"
ELLIPSES = "….．"
CLOSER_OF = {'"': '"', "“": "”", "„": "“”", "‚": "‘", "‘": "’", "«": "»", "»": "«", "‹": "›", "「": "」", "『": "』", "《": "》", "〈": "〉", "(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "〔": "〕", "'": "'"}
BRACKETS = set("([{（［【〔")
CLOSERS = set("".join(CLOSER_OF.values()))
#: Marks that can only close, and are no apostrophe.
ONLY_CLOSE = CLOSERS - set(CLOSER_OF) - {"’"}
OPENERS_OF = {x: [c for c, xs in CLOSER_OF.items() if x in xs] for x in ONLY_CLOSE}
_MARKS = regex.compile(r"[.．!?…;;。！？｡؟۔।॥።։᙮\"“”„‚‘’«»‹›「」『』《》〈〉(){}\[\]（）［］【】〔〕']|(?<=[ก-ฺเ-๎])[^\S\r\n]\s*(?=[ก-ฺเ-๎])|(?<=[ก-ฺเ-๎])\s*[^\S\r\n]\s*(?=[ก-ฺเ-๎])")
_LINE_END = r"(?>\r\n|[\n\r\u0085\u2028])"
_BLANK_LINE = regex.compile(rf"{_LINE_END}(?:[^\S\n\r\u0085\u2028]*{_LINE_END})+|\u2029")
_NUMBERED = regex.compile(r"[\W_]*(?:\p{L}+\s+)?\d+(?:\.\d+)*\.(?=\s)")
_SINGLE_CLOSE = regex.compile(r"[.,!?…]'(?![\p{L}\p{N}])")
_NOTE = regex.compile(r"\[\d{1,4}\]")
_WORD_BEFORE = regex.compile(r"[\p{L}\p{M}\p{N}.\-']+\Z")
#: The beginning of a line that is an item of a list: its indent, then a number, a letter or a bullet.
_ITEM = regex.compile(r"(?P<indent>[^\S\n\r\u0085\u2028]*)(?:(?P<number>\d{1,4}|[a-z])(?P<end>[.)])|(?P<bullet>[-*•‣◦·]))[^\S\n\r\u0085\u2028]+(?=\S)")
_BREAK = regex.compile(_LINE_END)


def speaker_pattern(verbs: dict[str, str] = SPEECH) -> regex.Pattern:
    """A capitalised name of up to three words and a verb of speech of any of the languages, since a text's language may be wrong."""
    words = "|".join(sorted({w for line in verbs.values() for w in line.split()}))
    return regex.compile(r"\p{Lu}[\p{L}'’-]*(?:\s+\p{Lu}[\p{L}'’-]*){0,2}\s+(?:" + words + r")\b")


_SPEAKER = speaker_pattern()
_END = "\0"


def build_trie(*lists: str) -> dict:
    """Trie of the words read backwards; a word's end holds the place of its list."""
    root: dict = {}
    for kind, words in enumerate(lists):
        for word in words.split():
            node = root
            for c in reversed(word):
                node = node.setdefault(c, {})
            node.setdefault(_END, kind)
    return root


ABBREVIATIONS = build_trie(TITLES, BEFORE_NUMBERS, MAYBE)
_ORDINAL_WORDS = frozenset(AFTER_ORDINALS.split())
_OPENERS = frozenset(GERMAN_OPENERS.split())


def abbreviation(text: str, dot: int, start: int) -> int | None:
    """0, 1 or 2 if a title, a word before numbers or a doubtful abbreviation ends at ``dot``."""
    node, i, found = ABBREVIATIONS, dot - 1, None
    while i >= start:
        node = node.get(text[i].lower())
        if node is None:
            break
        if _END in node and (i == start or not (text[i - 1].isalnum() or unicodedata.category(text[i - 1])[0] == "M")):
            found = node[_END]
        i -= 1
    return found


def _skip(text: str, i: int, stop: int) -> int:
    while i < stop and (text[i].isspace() or unicodedata.category(text[i]) == "Cf"):
        i += 1
    return i


class Automaton:
    """One paragraph at a time: ``units`` gives (start, end) of its sentences."""

    def __init__(self, text: str, lang: str | None, speaker: regex.Pattern = _SPEAKER) -> None:
        self.text, self.lang, self.speaker = text, (lang or "").lower(), speaker
        self.german = self.lang == "de"
        self.last = len(text.rstrip())

    def units(self) -> list[tuple[int, int]]:
        out, at = [], 0
        for gap in _BLANK_LINE.finditer(self.text):
            out += self.listed(at, gap.start())
            at = gap.end()
        return out + self.listed(at, len(self.text))

    def listed(self, start: int, stop: int) -> list[tuple[int, int]]:
        """The units of one paragraph, each item of a list apart from the others."""
        items = self.items(start, stop)
        if not items:
            return self.paragraph(start, stop)
        out = self.paragraph(start, items[0][0])
        for (a, mark), b in zip(items, [x[0] for x in items[1:]] + [stop]):
            out += self.paragraph(a, b, mark)
        return out

    def items(self, start: int, stop: int) -> list[tuple[int, int]]:
        """(start, place of the mark after the number) of the items of lists, by a stack of the open levels.

        An item goes on a level if it has its indent and bullet or its next number, which closes the
        levels within. The first number or a bullet opens a level, at the beginning of the paragraph, after
        a colon or an end mark, or within an item. A level of one item is no list.
        """
        levels: list[list] = []  # kind, value, the places of the items, indent
        every: list[list] = []
        for line in (start, *(m.end() for m in _BREAK.finditer(self.text, start, stop))):
            m = _ITEM.match(self.text, line, stop)
            if not m:
                continue
            number, indent = m["number"], m["indent"]
            if number:
                value = int(number) if number.isdigit() else ord(number) - 96
                kind = (number.isdigit(), m["end"])
            else:
                value, kind = 0, (m["bullet"], indent)
            at = next((i for i in range(len(levels) - 1, -1, -1) if levels[i][0] == kind and value == levels[i][1] + (1 if number else 0)), None)
            place = (m.end("indent"), m.start("end") if number else -1)
            if at is not None:
                del levels[at + 1 :]
                levels[at][1] = value
                levels[at][2].append(place)
            elif value <= 1 and (levels or self.may_open(start, m.start())):
                again = next((i for i, level in enumerate(levels) if level[0] == kind and level[3] == indent), len(levels))
                del levels[again:]
                levels.append([kind, value, [place], indent])
                every.append(levels[-1])
        return sorted(p for _, _, places, _ in every if len(places) > 1 for p in places)

    def may_open(self, start: int, i: int) -> bool:
        while i > start and self.text[i - 1].isspace():
            i -= 1
        return i == start or self.text[i - 1] in ":.!?…" + ALWAYS

    def paragraph(self, start: int, stop: int, mark: int = -1) -> list[tuple[int, int]]:
        """The units of a piece of text without list items inside; ``mark`` is the one after its own number."""
        text = self.text
        while stop > start and (text[stop - 1].isspace() or unicodedata.category(text[stop - 1]) == "Cf"):
            stop -= 1
        begin = _skip(text, start, stop)
        if begin >= stop:
            return []
        heading = mark
        if mark < 0 and text[stop - 1] not in ".!?…" + ALWAYS and (m := _NUMBERED.match(text, begin, stop)):
            heading = m.end() - 1
        self.ends_at, self.span = {}, (begin, stop)
        out: list[tuple[int, int]] = []
        signs: set[int] = set()
        at, done = begin, begin  # marks before ``done`` are part of what was read
        while True:
            begin, stack, resume = self.read(at, begin, done, stop, heading, signs, out)
            cut = next((n for n, (c, i) in enumerate(stack) if self.cut_off(c, i, stop)), len(stack))
            if not stack or cut == 0:
                break
            # what is open at the end was never closed; nothing was given out since the first of it
            signs.update(i for _, i in stack[:cut])
            at, done = stack[0][1], resume
        if begin < stop:
            out.append((begin, stop))
        return out

    def read(self, at: int, begin: int, done: int, stop: int, heading: int, signs: set[int], out: list[tuple[int, int]]) -> tuple[int, list[tuple[str, int]], int]:
        """Reads the marks from ``at`` on; gives the start of the open unit, what is still open, and ``done`` where the first of it opened."""
        text, resume = self.text, done
        stack: list[tuple[str, int]] = []
        waiting = dict.fromkeys(CLOSER_OF, 0)
        for m in _MARKS.finditer(text, at, stop):
            i, c = m.start(), m[0][0]
            if i < done or i == heading:
                continue
            if c.isspace():
                if not stack and i > begin:
                    out.append((begin, i))
                    begin = done = m.end()
                continue
            if c in ONLY_CLOSE and any(waiting[x] for x in OPENERS_OF[c]):
                while c not in CLOSER_OF[stack[-1][0]]:  # the mark around it closes, so this was a mere sign
                    waiting[stack.pop()[0]] -= 1
            if stack and c in CLOSER_OF[stack[-1][0]] and self.closes(stack[-1][0], i, stop):
                opener, opened = stack.pop()
                waiting[opener] -= 1
                end = i + 1
                if not stack and self.mark_before(i, opened) and not self.mark_after(end, stop):
                    end = self.closing(end, stop)
                    if self.ends_after_close(begin, opener, opened, end, stop):
                        out.append((begin, end))
                        begin = _skip(text, end, stop)
                    done = max(done, end)
                continue
            if c in CLOSER_OF and i not in signs and self.opens(c, i, stop):
                if not stack:
                    resume = done
                stack.append((c, i))
                waiting[c] += 1
                continue
            if c in CLOSERS or c in CLOSER_OF or stack:
                continue
            end = i + 1
            while end < stop and text[end] in ".．!?…" + ALWAYS:
                end += 1
            run = text[i:end]
            after = self.closing(end, stop)
            if self.ends(begin, i, run, after, stop):
                out.append((begin, after))
                begin = _skip(text, after, stop)
                done = max(begin, after)
            else:
                done = end
            if begin >= stop:
                break
        return begin, stack, resume

    # --- the stack -------------------------------------------------------------------------

    def opens(self, c: str, i: int, stop: int) -> bool:
        """Whether ``c`` opens something that may be closed in the paragraph, or is cut off with the text."""
        text = self.text
        before = text[i - 1] if i else " "
        if c in "'‘‚" and (before.isalnum() or i + 1 >= stop or not text[i + 1].isalnum()):
            return False
        if c == '"' and before.isalnum() and i + 1 < stop and text[i + 1].isspace():
            return False
        return self.last_closing(c) > i or self.cut_off(c, i, stop)

    def last_closing(self, c: str) -> int:
        """The last place in the paragraph that may close ``c``, looked up once."""
        if c not in self.ends_at:
            if c == "'":
                self.ends_at[c] = max((m.end() - 1 for m in _SINGLE_CLOSE.finditer(self.text, *self.span)), default=-1)
            else:
                self.ends_at[c] = max(self.text.rfind(x, *self.span) for x in CLOSER_OF[c])
        return self.ends_at[c]

    def cut_off(self, c: str, i: int, stop: int) -> bool:
        """Whether the text is cut off within the speech that ``c`` opens: it ends in its last paragraph without an end mark."""
        text = self.text
        before = text[i - 1] if i else " "
        speech = c in '"“„«「『' and (before.isspace() or not before.isalnum()) and i + 1 < stop and text[i + 1].isalnum()
        return speech and stop >= self.last and text[stop - 1] not in ".!?…．" + ALWAYS

    def closes(self, opener: str, i: int, stop: int) -> bool:
        if opener in "'‘":  # an apostrophe inside a word does not close
            after = self.text[i + 1] if i + 1 < stop else " "
            return not after.isalnum() and (opener == "‘" or self.text[i - 1] in ".,!?…")
        return True

    def closing(self, end: int, stop: int) -> int:
        """The place after the closing marks and note numbers that follow directly."""
        text = self.text
        while end < stop:
            if text[end] in CLOSERS and (text[end] not in CLOSER_OF or (text[end] in "\"'“»" and self.trails(end, stop))):
                end += 1
            elif note := _NOTE.match(text, end, stop):
                end = note.end()
            else:
                break
        return end

    def trails(self, i: int, stop: int) -> bool:
        """A mark that could open or close closes here if no letter follows directly."""
        return i + 1 >= stop or not self.text[i + 1].isalnum() and self.text[i + 1] not in "¿¡"

    def mark_before(self, i: int, opened: int) -> bool:
        j = i - 1
        while j > opened and (self.text[j].isspace() or self.text[j] in CLOSERS):
            j -= 1
        return j > opened and (self.text[j] in ".!?…．" + ALWAYS or self.greek_question(j))

    def mark_after(self, i: int, stop: int) -> bool:
        return i < stop and self.text[i] in ".!?…" + ALWAYS

    # --- decisions -------------------------------------------------------------------------

    def greek_question(self, i: int) -> bool:
        if self.text[i] == ";":
            return True
        return self.text[i] == ";" and i > 0 and "Ͱ" <= self.text[i - 1] <= "Ͽ" or self.text[i] == ";" and i > 0 and "ἀ" <= self.text[i - 1] <= "῿"

    def starts_sentence(self, j: int, stop: int, spaced: bool) -> bool:
        """Whether a sentence could start at the visible character ``j``."""
        text, first = self.text, j
        while j < stop and text[j] in "\"'“„«‹‘‚([¿¡—–-•*「『《（【":
            j += 1
        if j >= stop:
            return True
        c = text[j]
        if c.islower():
            word = regex.match(r"[\p{L}]+", text[j : j + 40])
            return bool(word) and any(x.isupper() for x in word[0])
        if c.isupper():
            return True
        return spaced or j > first if c.isalnum() else c not in ",;:)]}»”…%/&+="

    def ends_after_close(self, begin: int, opener: str, opened: int, end: int, stop: int) -> bool:
        """A quotation or bracket with an end mark inside has just closed."""
        text = self.text
        j = _skip(text, end, stop)
        if j >= stop:
            return True
        first = not any(x.isalnum() for x in text[begin:opened])
        if opener in BRACKETS and not first:
            return False
        c = text[j]
        if c.isalpha() and not (c.isupper() or c.islower()):  # a script without cases
            if opener in BRACKETS:
                return True
            return not first and not "ぁ" <= c <= "ゟ"
        if not self.starts_sentence(j, stop, j > end):
            return False
        return not self.speaker.match(text, j, stop)

    def ends(self, begin: int, i: int, run: str, after: int, stop: int) -> bool:
        """Whether the marks ``run`` at ``i``, with nothing open, end the sentence."""
        text, c = self.text, run[0]
        if c in ";;" and not self.greek_question(i):
            return False
        j = _skip(text, after, stop)
        if j >= stop:
            return True
        spaced = j > after
        nxt = text[j]
        if any(x in ALWAYS for x in run):
            return nxt not in "，、,；;：:"
        uncased = nxt.isalpha() and not (nxt.isupper() or nxt.islower())
        if any(x in CASED for x in run) or c in ";;":
            if not spaced and not nxt.isupper() and not uncased:
                return nxt in "\"'“„«([（「『《¿¡—–"
            return self.starts_sentence(j, stop, spaced)
        if "…" in run or len(run) > 1:  # an ellipsis
            return spaced and not uncased and self.starts_sentence(j, stop, spaced) and not nxt.isdigit()
        word = _WORD_BEFORE.search(text, max(begin, i - 40), i)
        token = word[0] if word else ""
        if not spaced:
            if after > i + 1 or not token:
                return nxt.isupper() and bool(token or after > i + 1)
            tail = token.rpartition(".")[2]
            following = text[j + 1] if j + 1 < stop else " "
            return nxt.isupper() and "." not in token and (following.islower() or following.isspace()) and (len(tail) > 1 and (tail[-1].islower() or tail.isdigit()))
        kind = abbreviation(text, i, begin)
        if kind == 0 or kind == 1 and nxt.isdigit():
            return False
        letters = token.rpartition(".")[2]
        if kind in (None, 1) and len(letters) == 1 and (letters.isupper() or letters.islower()):
            return False  # an initial
        if letters.isdigit() and len(letters) <= 2 and "." not in token and after == i + 1:
            if nxt.isdigit() and (self.german or self.lang in ("", "und", "tr")):
                return False
            following = regex.match(r"[\p{L}]+", text[j : j + 30])
            if following and following[0].lower() in _ORDINAL_WORDS:
                return False
            counted = text[begin : i - len(letters)].rstrip().endswith(".")  # a number after an abbreviation, as in "S. 9"
            if self.german and not counted and nxt.isupper() and following and following[0].lower() not in _OPENERS:
                return False
        return self.starts_sentence(j, stop, spaced)


def split_text(text: str | None, lang: str | None = None, speaker: regex.Pattern = _SPEAKER) -> list[tuple[int, int]]:
    """(start, end) of each unit of one text."""
    return Automaton(text, lang, speaker).units() if text else []


def _split(batches: Iterator[pa.RecordBatch], verbs: dict[str, str] | None = None) -> Iterator[pa.RecordBatch]:
    speaker = speaker_pattern(verbs) if verbs else _SPEAKER
    for batch in batches:
        ids, numbers, starts, ends, units = [], [], [], [], []
        for key, text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            for n, (a, b) in enumerate(split_text(text, lang, speaker)):
                ids.append(key)
                numbers.append(n)
                starts.append(a)
                ends.append(b)
                units.append(text[a:b])
        columns = [pa.array(ids, batch.schema.field(0).type), pa.array(numbers, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(units, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.field(0).name, "sentence_no", "start_char", "end_char", "sentence"])


def split_sentences(texts: DataFrame, id_column: str = "uima_id", text_column: str = "text", lang_column: str = "lang", verbs: dict[str, str] | None = None) -> DataFrame:
    """(id, sentence_no, start_char, end_char, sentence) of every text; ``verbs`` of speech by language. One shuffle, to count each id once."""
    key = f"{id_column} {texts.schema[id_column].dataType.simpleString()}"
    one = texts.where(F.col(id_column).isNotNull() & (F.length(text_column) > 0)).select(id_column, text_column, lang_column).dropDuplicates([id_column])
    return one.mapInArrow(lambda batches: _split(batches, verbs), f"{key}, sentence_no int, start_char int, end_char int, sentence string")
