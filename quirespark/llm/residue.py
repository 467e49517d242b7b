"""Template residue, filler, error pages and script notices.

Method. Unfilled placeholders are found by grammars specific to their
delimiters and by patterns for filler, error pages and script notices.
Context discounts: fenced and inline code, quoted passages, and sentences
that explain (a placeholder in "the guide explains that ... are replaced" is
spoken about). Error messages count by density, block by block (a block is what
blank lines enclose): a block whose better part is an error message with its
code, or a trace of a failed program, counts in a text of any length, unless
the block before leads it in; messages without a code have to be the better
part of the whole text. A text's verdict comes from its own lines alone.

Defined results
* null, empty or blank text: no residue.
* model control tokens and markup tags are no placeholders.
* whole texts are read, and nothing depends on their length: a single unfilled
  placeholder or error message in a long text counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ID = r"[A-Za-z_][A-Za-z0-9_.]*"
_ANYNAME = r"[^\W\d_][\w ./-]{0,40}"
# Grammars that program code has too; found in code they prove nothing.
_CODE_LIKE = re.compile(
    rf"\{{\{{\s*{_ID}(?:\s*\|[^{{}}]{{0,30}})?\s*\}}\}}|\$\{{\s*{_ID}\s*\}}|\#\{{\s*{_ID}\s*\}}|%\({_ID}\)[sdf]|<%=?\s*{_ID}\s*%>|\{{%\s*{_ANYNAME}\s*%\}}"
    rf"|(?<![\w_])__[A-Za-z]{{3,}}(?:_[A-Za-z]+)*__(?![\w_])|%[A-Z_]{{4,}}%|\[\[\s*{_ID}\s*\]\]|(?<![\w{{$\#%])\{{{_ID}\}}(?!\}})|\[object Object\]"
    rf"|&lt;{_ID}&gt;|\{{\{{\s*{_ID}\s|\s{_ID}\s*\}}\}}"
)
# Grammars that are only ever written for a person to fill in.
_FOR_PEOPLE = re.compile(
    r"@@[A-Za-z]\w*@@|\#\#[A-Z]\w*\#\#|(?<!\w)(?:[Xx]{2}([/.\-])[Xx]{2}\1[Xx]{2,4}|(?:DD|MM|YYYY)([/.\-])(?:DD|MM|YYYY)\2(?:DD|MM|YYYY))(?!\w)"
    r"|\[\s*(?:INSERT|Insert|insert|YOUR|Your|ENTER|Enter|enter|ADD|TBD|TODO|FILL|Fill|fill)\b[^\[\]\n]{0,50}\]?|\[[^\[\]\n]{1,40}\s(?:HERE|here|Here)\]"
    r"|\[[A-Z]{3,}(?:[_ ][A-Z]+)+\]|\[[a-z]+(?:_[a-z]+)+\]|\[(?=[^\[\]]*(?:rellenar|completar|insertar|einsetzen|einfügen|ausfüllen|eintragen|compléter|insérer|remplir|uzupełni|wpisz|wstaw|вставить|вписать|заполнить|вставити|вписати|заповнити))[^\[\]\n]{3,40}\]"
    r"|<(?=[^<>]*(?:HERE|YOUR |INSERT|rellenar|insertar|einsetzen|einfügen|compléter|insérer|uzupełni|wpisz|wstaw|вставить|вписать|вставити|вписати))[^<>\n]{3,40}>"
    r"|<[A-Z]{3,}(?:[_ ][A-Z]+)*>|<[a-z]+(?:_[a-z]+)+>"
    r"|(?<!\w)(?:TODO|FIXME|TBD)\s*:\s*\w+|\b(?:[Dd]escription|[Tt]ext|[Cc]ontent|[Tt]itle|[Nn]ame|[Ss]ummary) goes here\b|\b[Ss]ample text\. |\b[Rr]eplace this text\b|\$[A-Z_]{3,}\$"
    # a program's empty value where a value belongs: before a unit or another value, or after a preposition or a colon
    r"|\b(?:undefined|NaN|null) (?:of|from|out of|pages?|items?|results?)\b|(?:\b(?:by|[Ff]or|[Dd]ear|[Tt]o|[Aa]t|[Oo]f)|\w:) (?:undefined|NaN|null)\b"
)
_TAG = re.compile(r"<([a-z]{5,})>")
# Markup elements, which are no placeholders.
_MARKUP = frozenset("title table tbody thead tfoot small strong style script section article aside audio video canvas footer header label input button option select center frame object param source track meter legend fieldset caption colgroup details dialog figure iframe picture progress ruby samp summary template output start quote block image class think system user assistant".split())
_POSITIONAL = re.compile(r"(?<![\w{$])\{\d\}(?!\})|(?<![\w%])%[sd](?!\w)")
_EXPLAINS = re.compile(
    r"(?i)\b(?:explain\w*|look like|looks like|stands? for|replaced|template|templates|writes?|marked|braces|placeholders?|syntax|for example|e\.g\.|literally|means|escape\w*|spelled|called|variable)\b"
)
_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
# Settings files have no template syntax of their own but ${..} and {{..}}.
_SETTINGS = re.compile(r"```(?:ya?ml|json|toml|ini)\b(.*?)(?:```|\Z)", re.S)
_FOREIGN = re.compile(rf"#\{{\s*{_ID}\s*\}}|<%=?\s*{_ID}\s*%>|%\({_ID}\)[sdf]|\{{%\s*{_ANYNAME}\s*%\}}|(?<![\w_])__[A-Za-z]{{3,}}(?:_[A-Za-z]+)*__(?![\w_])|\[\[\s*{_ID}\s*\]\]")
_INLINE = re.compile(r"`[^`\n]+`")
_QUOTED = re.compile(r"“[^“”\n]*”|«[^«»\n]*»|„[^„“”\n]*[“”]|‘[^‘’\n]{2,}’(?!\w)")
_BLOCK = re.compile(r"\n\s*\n")
#: Longest line of a message: longer ones are running text.
MESSAGE_LINE = 160
_CODE_LINE = re.compile(r"^\s*(?:def |class |import |from \w+ import|return\b|for \w+ in |if .*:$|print\(|[\w.]+\s*=\s*[\w\[{(\"']|\w+\(.*\)\s*[;{]?\s*(?:#.*)?$)", re.M)

# Words of Latin filler text.
_FILLER = frozenset(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
# Names of filler text, by which it announces itself.
_NAMED_FILLER = re.compile(
    r"(?i)\b(?:blindtext|platzhaltertext|fülltext|dummy text|placeholder text|filler text|faux[- ]texte|texte (?:de remplissage|provisoire)|texto (?:de relleno|provisional|simulado)|tekst (?:zastępczy|przykładowy|wypełniający)|текст[- ]заполнитель|рыбный текст|текст[- ]рыба|текст[- ]заповнювач|зразок тексту)"
)
_MASH = re.compile(r"(?i)\b(?:asdf\w*|qwer\w*|jkl\b|sdfg\w*|zxcv\w*|hjkl\w*)")
_WORD = re.compile(r"[^\W\d_]+")

_REASON = (
    r"not found|could not|cannot be|can ?not|unavailable|denied|forbidden|unauthori[sz]ed|bad request|bad gateway|gateway time-?out|timed? ?out|did not answer|does not (?:answer|respond)|rate limit|too many|(?:internal )?server error|service error|quota|went wrong|\boops\b|connection (?:failed|refused|reset|closed)|session has expired|overloaded|maintenance|moved permanently|no longer available|not available"
    r"|introuvable|refusé|interdit|indisponible|erreur|délai|ne répond pas|mauvaise requête|no encontrad[ao]|denegado|prohibido|no disponible|tiempo de espera|no se pudo|no responde|solicitud"
    r"|nicht gefunden|nicht verfügbar|verweigert|verboten|konnte nicht|antwortet nicht|zeitüberschreitung|fehlgeschlagen|nicht erreichbar|ungültige anfrage"
    r"|nie znaleziono|brak dostępu|odmowa|niedostępn|przekroczono|nie odpowiada|nieprawidłowe|błąd|nie można"
    r"|не найден|запрещ|недоступ|не отвечает|ошибк|не удалось|превышен|не знайдено|заборонен|помилк|не відповідає|не вдалося|доступ"
)
_ERROR_WORD = r"(?:http(?:/\d\.\d)?|error(?: code)?|status(?: code)?:?|erreur|error del servidor|fehler(?:code)?|błąd|ошибка|помилка|código|code|err)"
_ERROR_LINE = re.compile(
    rf"(?i)^\W*(?:<[^>]+>\W*)*(?:{_ERROR_WORD}\s*:?\s*)?(?:4\d\d|5\d\d)\b(?:\s*[-–—:.,(]?\s*|\s+)(?:.{{0,40}}(?:{_REASON}).*|\W*)$|^\W*(?:<[^>]+>\W*)*{_ERROR_WORD}\s*:?\s*\d{{3}}\b.*$|^\W*(?:<[^>]+>\W*)*.{{0,40}}\b(?:{_REASON}).*$"
)
_HARD = re.compile(
    r"(?m)^Traceback \(most recent call last\)|^\s*File \".+\", line \d+|^\w*(?:Error|Exception): |^\s*\{\s*\"(?:error|errors)\"\s*:|^\s*\{\s*\"(?:status|code)\"\s*:\s*\"?[45]\d\d|Exception in thread|Segmentation fault|^Error opening data file|^Failed loading|^Fatal error|^Warning: \w+\(\)"
)
_AFTER = re.compile(r"(?i)retry[- ]after|try again|again later|intentar|inténtelo|réessay|erneut versuchen|später|spróbuj|повторите|спробуйте|go back|return to|retour|zurück|volver|sign in again|slow down|if the problem|\((?:ref|code|id) \w+\)|request id|contact the|powrót|вернуться|check the address|проверьте|перевірте|requested|angeforderte|demandé")
_SCRIPT = re.compile(r"(?i)java-?script|\bscripts?\b|\bscripting\b|skrypt\w*|скрипт\w*|script blocker|\bcookies?\b")
_NEEDS = re.compile(
    r"(?i)\benable|\bactivate\b|\bturn(?:ed)? (?:on|off your)|\bswitched on\b|\bneeded\b|\bneed to\b|\brequire[sd]?\b|does not support|\bmust\b|\bplease allow\b|aktivier\w+|einschalten|benötig\w+|\bactive[rz]?\b|activez|habilit\w+|requier\w+|nécessaire|włącz\w*|wymaga\w*|включите|требуется|увімкніть|потрібен|необхід"
)
# A sentence about other people or about what goes on all the same reports, and demands nothing.
_REPORTS = re.compile(r"(?i)\b(?:who|whoever|anyone|everyone)\b|\bstill\b")
_CHECK = re.compile(r"(?i)checking (?:your|the) browser|verify(?:ing)? (?:that )?you are (?:a )?human|i am not a robot|complete the captcha|solve the captcha|unusual traffic|browser check|проверка браузера|перевірка браузера|überprüf\w+ (?:ihren|deinen|ihres) browser|vérification de votre navigateur|sprawdzanie przeglądarki|comprobando (?:su|tu) navegador")
# Substrings without which no pattern of a kind can match: cheap to look for in long texts.
_MARKS = ("{", "}", "@@", "%", "$", "#", "[", "<", "__", "&lt;")
_PHRASES = ("goes here", "sample text", "replace this", "nan of nan", "undefined", "todo", "tbd", "fixme", "xx/xx", "xx.xx", "xx-xx", "dd/", "mm/", "yyyy", "dd.", "mm.", "dd-", "mm-", " nan", " null")
_STEMS = (
    "not found", "could not", "cannot", "can not", "unavailable", "denied", "forbidden", "unauthori", "bad request", "bad gateway", "gateway time", "time out", "timeout", "timed", "did not answer", "does not answer", "does not respond",
    "rate limit", "too many", "server error", "service error", "quota", "went wrong", "oops", "connection ", "session has expired", "overloaded", "maintenance", "moved permanently", "no longer available", "not available", "introuvable", "refusé",
    "interdit", "indisponible", "erreur", "délai", "ne répond pas", "mauvaise requête", "no encontrad", "denegado", "prohibido", "no disponible", "tiempo de espera", "no se pudo", "no responde", "solicitud", "nicht gefunden", "nicht verfügbar",
    "verweigert", "verboten", "konnte nicht", "antwortet nicht", "zeitüberschreitung", "fehlgeschlagen", "nicht erreichbar", "ungültige anfrage", "nie znaleziono", "brak dostępu", "odmowa", "niedostępn", "przekroczono", "nie odpowiada",
    "nieprawidłowe", "błąd", "nie można", "не найден", "запрещ", "недоступ", "не отвечает", "ошибк", "не удалось", "превышен", "не знайдено", "заборонен", "помилк", "не відповідає", "не вдалося", "доступ",
)
_STARTS = re.compile(r"(?mi)^[^\w\n]*(?:<[^>\n]+>[^\w\n]*)*(?:[45]\d\d\b|http|error|status|erreur|fehler|błąd|ошибка|помилка|código|code|err\b)")
_TRACES = ("Traceback", 'File "', "Error: ", "Exception: ", '"error', '"status"', '"code"', "Exception in thread", "Segmentation fault", "Error opening", "Failed loading", "Fatal error", "Warning: ")
_FILLER_NAMES = ("blindtext", "platzhaltertext", "fülltext", " text", "faux", "texte ", "texto ", "tekst ", "текст")
_CHECKED = ("browser", "human", "robot", "captcha", "traffic", "браузер", "navigateur", "przegląd", "navegador")


def _sentence(text: str, at: int) -> str:
    a = max(text.rfind(". ", 0, at), text.rfind("\n\n", 0, at), text.rfind("! ", 0, at), text.rfind("? ", 0, at))
    ends = [e for e in (text.find(". ", at), text.find("\n\n", at), text.find(".\n", at)) if e >= 0]
    return text[a + 1 : min(ends, default=len(text)) + 1]


def placeholders(text: str) -> list[str]:
    """Unfilled placeholders that the text doesn't quote, explain or hold as code."""
    low = text.lower()
    if not any(x in text for x in _MARKS) and not any(x in low for x in _PHRASES):
        return []
    bare = _QUOTED.sub(" ", _INLINE.sub(" ", text))
    prose = _FENCE.sub("\n", bare)
    code_lines = len(_CODE_LINE.findall(prose))
    out: list[str] = []
    explained: set[str] = set()
    for pattern, where in ((_FOR_PEOPLE, bare), (_CODE_LIKE, prose), (_POSITIONAL, prose)):
        if pattern is not _FOR_PEOPLE and code_lines >= 3:
            continue
        for m in pattern.finditer(where):
            (explained.add if _EXPLAINS.search(_sentence(where, m.start())) else out.append)(m.group(0))
    if "```" in bare:
        for block in _SETTINGS.finditer(bare):
            out += [m.group(0) for m in _FOREIGN.finditer(block[1])]
    for m in _TAG.finditer(prose):
        if m[1] not in _MARKUP and f"</{m[1]}>" not in prose and not _EXPLAINS.search(_sentence(prose, m.start())):
            out.append(m.group(0))
    # an explanation names one or two; more of different kinds are left over
    return out or (sorted(explained) if len(explained) >= 3 else [])


def filler(text: str) -> bool:
    """Latin filler running over eight words or more, keyboard mash, a text that is one word over and over, or a block that is one sentence calling itself filler."""
    low = text.lower()
    if any(x in low for x in ("ipsum", "dolor", "aliqu", "nostrud", "veniam", "tempor", "commodo", "labore", "ullamco")):
        run = 0
        for w in _WORD.findall(low):
            run = run + 1 if w in _FILLER else 0
            if run >= 8:
                return True
    first = _WORD.search(low)
    if first and all(m[0] == first[0] for m in _WORD.finditer(low)) and len(_WORD.findall(low)) >= 4:
        return True
    for m in _NAMED_FILLER.finditer(text) if any(x in low for x in _FILLER_NAMES) else ():
        start, end = _block(text, m.start())
        block = text[start:end].strip()
        if len(_ENDS.findall(block)) <= 2 and _NAMED_FILLER.search(_QUOTED.sub(" ", block)) and not _EXPLAINS.search(block):
            return True
    return len(_MASH.findall(low)) >= 2 if ("asdf" in low or "qwer" in low or "zxcv" in low) else False


_ENDS = re.compile(r"[.!?](?:\s|$)")


def _block(text: str, at: int) -> tuple[int, int]:
    """Start and end of the block that holds a position."""
    start = max((m.end() for m in _BLOCK.finditer(text, 0, at)), default=0)
    end = _BLOCK.search(text, at)
    return start, end.start() if end else len(text)


_CODE_FIRST = re.compile(rf"(?i)^\W*(?:<[^>]+>\W*)*(?:{_ERROR_WORD}\s*:?\s*)?(?:4\d\d|5\d\d)\b")


def _may_be_error(text: str) -> bool:
    """Whether an error message could stand in the text: a cheap screen before the patterns."""
    low = text.lower()
    return any(x in low for x in _STEMS) or bool(_STARTS.search(text))


def _message(lines: list[str]) -> tuple[float, bool, bool]:
    """(share of the characters in lines of error messages, whether one names a code, whether any is an error)."""
    errors = [x for x in lines if len(x) <= MESSAGE_LINE and _may_be_error(x) and _ERROR_LINE.match(x)]
    if not errors:
        return 0.0, False, False
    total = sum(map(len, lines))
    bad = sum(len(x) for x in lines if len(x) <= MESSAGE_LINE and (_ERROR_LINE.match(x) or _AFTER.search(x)))
    return bad / total, any(_CODE_FIRST.match(x) for x in errors), bool(errors)


def error_page(text: str) -> bool:
    """Whether a block of the text is an error message of its own, or messages are the better part of the text."""
    hard = any(x in text for x in _TRACES) and bool(_HARD.search(text))
    if not hard and not _may_be_error(text):
        return False
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    share, coded, errors = _message(lines)
    if errors and share >= 0.5:
        return True
    if hard:
        # a trace in a fence is an example, unless it is the text's better part
        fenced = sum(len(m[0]) for m in _FENCE.finditer(text) if _HARD.search(m[0].strip("`~ \n")))
        if fenced >= 0.5 * len(text):
            return True
    elif not coded:
        return False
    before = ""
    for block in _BLOCK.split(_FENCE.sub("\n\n", text)):
        own = [x.strip() for x in block.split("\n") if x.strip()]
        if not own:
            continue
        if not (before.endswith(":") or _EXPLAINS.search(before.rsplit(". ", 1)[-1]) or _EXPLAINS.search(block)):
            if _HARD.search(block):
                return True
            share, coded, _ = _message(own)
            if coded and share >= 0.5 and not _tabular(own):
                return True
        before = block.strip()
    return False


def _tabular(lines: list[str]) -> bool:
    """Whether the lines are rows of numbers, among which a code is a figure like others."""
    return not any(re.search(rf"(?i)(?:{_REASON})|{_ERROR_WORD}\b", x) for x in lines)


def script_notice(text: str) -> bool:
    """A demand for scripts or a notice of a browser check, in the text's own voice."""
    low = text.lower()
    if "script" in low or "skrypt" in low or "скрипт" in low or "cookie" in low:
        bare = _QUOTED.sub(" ", _INLINE.sub(" ", _FENCE.sub("\n", text)))
        for m in _SCRIPT.finditer(bare):
            s = _sentence(bare, m.start())
            if _NEEDS.search(s) and not _REPORTS.search(s):
                return True
    return any(x in low for x in _CHECKED) and bool(_CHECK.search(text))


def residue(text: str | None) -> list[str]:
    """Kinds of residue in the text: ``placeholder``, ``filler``, ``error``, ``script``."""
    if not text or not text.strip():
        return []
    out = []
    if placeholders(text):
        out.append("placeholder")
    if filler(text):
        out.append("filler")
    if error_page(text):
        out.append("error")
    if script_notice(text):
        out.append("script")
    return out


@F.arrow_udf(T.ArrayType(T.StringType()))
def _residue(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in it:
        yield pa.array([residue(t) for t in texts.to_pylist()], pa.list_(pa.string()))


def template_residue(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``residue`` (kinds found, empty if none). Narrow: one scan, no shuffle."""
    return df.withColumn("residue", _residue(F.col(text)))


def without_residue(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` that hold no residue."""
    return template_residue(df, text).filter(F.size("residue") == 0).drop("residue")


def found(df: DataFrame) -> DataFrame:
    """p10_found: documents that are, or in part are, residue."""
    return template_residue(df.select("doc_id", "text")).filter(F.size("residue") > 0).select("doc_id").distinct()
