"""Template residue, filler, error-page messages and script notices inside documents.

Every document is cut into lines and sentences. Addresses, dates and numbers are masked, and what remains
is lower-cased and hashed; equal hashes are one *message*, counted over documents and sources. Each message is
judged once: placeholder grammar and phrases that can only be residue count at any frequency, phrases that a
writer could also use count only for messages that recur widely. A document is a case if it holds a judged
message. Sentences that speak of a placeholder or quote an error are told apart by what stands around it.
"""

from __future__ import annotations

import re
import re._constants as parts
import re._parser as parser
from functools import reduce
from itertools import groupby
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise

#: A message recurs widely from this many documents in this many sources.
WIDE_DOCUMENTS = 3
WIDE_SOURCES = 2
#: Documents of one hot message are spread over this many groups when messages are joined back.
SALTS = 16

_NAME = r"[\p{L}][\p{L}\p{N}_.>\-]*"
_TAG = r"(?i)</?(?:div|p|span|br|li|ul|ol|td|tr|th|table|h[1-6]|body|html|head|section|article|nav|footer|header|a|b|i|em|strong|font|img|sup|sub|script|style|pre|code)(?:\s[^<>]*+)?/?>"

#: What asks the reader to fill in something.
_ASK = r"(?:insert|enter|fill in|fill|add|your|put|type|replace|hier einsetzen|einsetzen|hier|ergänzen|eintragen|bitte|à compléter|compléter|insérer|votre|remplir|insertar|inserte|completar|rellenar|su|poner|todo|tbd|tk|填写|填入|请填|此处|在此|待填|待补充|输入|插入|补充|待补)"

#: Grammar of unfilled places, tried anywhere in a message.
PLACEHOLDERS = {
    "braces": r"\{\{\{?[^{}]++\}\}\}?",
    "dollar": rf"[$#]\{{[^{{}}]++\}}|\$\(\s*{_NAME}[^()]*+\)",
    "angles": r"<<\s*[\p{L}][^<>]*+>>",
    "brackets": r"\[\[\s*[\p{L}][^\[\]]*+\]\]",
    "statement": r"\{%[^{}]{2,}+(?<=%)\}|<%[^<>]{2,}+(?<=%)>",
    "at_signs": r"@@[^@\s][^@]*+@@",
    "merge_tag": r"\*\|[^|]++\|\*",
    "percent": rf"%\(\s*{_NAME}\)[sd]|(?<![\p{{N}}\p{{IsLatin}}])%{_NAME}%(?!\p{{IsLatin}})",
    "underscores": rf"(?<![\p{{IsLatin}}\p{{N}}_])__{_NAME}__(?!_)",
    "single_brace": rf"(?<![\p{{IsLatin}}\p{{N}}])\{{(?!otu_?0)(?:{_NAME}|0)\}}",
    "asks": rf"[\[<【«‹]\s*{_ASK}(?![\p{{Ll}}])[^\[\]<>【】»›]*+[\]>】»›]",
    "mark": r"⟦unfilled⟧",
    "three_x": r"(?<![\p{IsLatin}\p{N}])(?:(?:x{3,12}|n{3,8}|tbd)(?![\p{IsLatin}\p{N}])|todo:)|\?{2,}\.\?{2,}|\?{4,}",
}

#: Where a text is cut into messages, and marks that are one place even if such a cut lies between them.
_CUT = r"(?:[\r\n\x{2028}\x{85}]|[.!?…]['\"”’)]{0,2}\s|[。!?])"
_TWO_SIDED = "|".join(
    f"{start}(?={inside}*+{end}){inside}*?{_CUT}{inside}*+{end}"
    for start, inside, end in ((r"\{\{\{?", "[^{}]", r"\}\}\}?"), (r"[$#]\{", "[^{}]", r"\}"), (r"<<\s*\p{L}", "[^<>]", ">>"), (r"\[\[\s*\p{L}", r"[^\[\]]", r"\]\]"), (r"\{%", "[^{}]", r"(?<=%)\}"), (r"<%", "[^<>]", "(?<=%)>"), (r"\*\|", "[^|]", r"\|\*"))
)

#: Words of a sentence that speaks of a placeholder instead of holding one.
_SPOKEN_OF = r"(?:\btemplates?\b|\bmarker\b|\bplaceholders?\b|naming rule|\bthe printer fills\b|platzhalter|vorlage|\bmod[èe]le\b|\ble champ\b|\bplantilla\b|\bla marca\b|模板|占位符|变量)"

#: Words of the usual filler.
_LATIN_WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed tempor incididunt labore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur occaecat cupidatat proident culpa officia deserunt mollit laborum".split()
_LATIN = r"\b(?:" + "|".join(f"{c}(?:{'|'.join(w[1:] for w in ws)})" for c, ws in groupby(sorted(_LATIN_WORDS), lambda w: w[0])) + r")\b"
_MASH = r"(?<![\p{L}\p{N}])(?:asdf|qwer(?:ty)?|uiop|zxcv|hjkl|jkl;|sdfg?dfgh|dfgh|sdfg|sdfgdfgh|aaaa|bbbb|cccc|dddd)(?![\p{L}\p{N}])"
_HAN = r"[\x{2e80}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}]"
#: A word, two words or a few Chinese characters over and over.
_REPEATED = rf"(?<!\p{{L}})(?:(\p{{L}}{{2,12}}+)(?: \1){{4,}}|(\p{{L}}{{2,12}}+ \p{{L}}{{2,12}}+)(?: \2){{4,}})|({_HAN}{{2,8}})\3{{2,}}"
_COPY = r"(?:(?:a |an |the |your |some |real )*(?:placeholder(?: paragraph| text)?|dummy (?:copy|text)|body text|sample text|example (?:content|text)|filler text|caption|description|text)\b)"

#: Filler, from the start of a message.
FILLER = [
    rf"^(?:click (?:here )?to edit|insert here|here goes|replace (?:this )?with|replace)\s+{_COPY}",
    r"^add (?:a placeholder|dummy|body text|sample text|example|your (?:description|text|caption)|the real caption)",
    r"^this is (?:a placeholder|(?:just )?dummy|body text|sample text|(?:an )?example (?:content|text)|your description|the real caption|filler)",
    r"^your (?:description|text|caption) (?:here|goes here)",
    r"^(?:beispieltext|blindtext|mustertext|f.{1,3}lltext|platzhaltertext|platzhalter f|hier steht sp)",
    r"^(?:texto de relleno|texto de ejemplo|texto de muestra|este es un texto de ejemplo|su descripci.{1,3}n aqu|aqu.{1,3} va)",
    r"^(?:texte de remplissage|texte d.exemple|faux texte|texte . remplacer|ceci est un texte|votre description ici|votre texte ici|ici viendra)",
    r"^(?:示例(?:内容|文字|文本)|此处为(?:示例|占位)|这里是(?:占位|示例)|占位(?:文本|文字|内容)|正文待补充|内容待补充|待补充|请在此(?:输入|填写)|在此(?:输入|填写))",
    r"^(?:test 0 ?){2}",
]
#: Demands for scripts, cookies or another browser, from the start of a message.
_SCRIPT = r"(?:java ?script|scripts?|(?:active |client.?side )?(?:scripting|scripts)|cookies?|js)\b"
NOTICES = [
    rf"^(?:please |kindly |you (?:need|have) to |you must |to continue,? (?:please )?)*(?:enable|activate|switch on|turn on|allow|accept)\s+(?:your )?{_SCRIPT}(?! (?:was|were|is|are|lets?|made|helped)\b)",
    rf"^(?:sorry,? )?this (?:page|site|view|viewer|plate|content|app|application|works?)\b.{{0,12}}(?:requires?|needs?|only with) {_SCRIPT}",
    rf"^{_SCRIPT} (?:is|are|must be) (?:required|needed|disabled|turned off|switched off|enabled)\b",
    r"^(?:we noticed that )?(?:your|this) browser (?:does not|doesn.t|cannot|can.t|is not|isn.t|blocks|is too old|is outdated|is no longer)",
    r"^please (?:upgrade|update|use|try|switch to) (?:your|another|a (?:newer|modern|different)|a supported) browser",
    rf"^(?:bitte )?(?:aktivieren|erlauben) sie (?:bitte )?{_SCRIPT}|^ihr browser unterst.{{1,3}}tzt kein|^f.{{1,3}}r diese (?:ansicht|seite) (?:muss|wird|ist) {_SCRIPT}|^{_SCRIPT} (?:ist erforderlich|muss (?:aktiviert|eingeschaltet))|^diese seite (?:ben.{{1,3}}tigt|erfordert) {_SCRIPT}|^bitte (?:schalten sie {_SCRIPT}|verwenden sie einen anderen browser)",
    rf"^(?:veuillez|merci d.)\s*(?:activer|autoriser|accepter) {_SCRIPT}|^votre navigateur (?:ne|n.est)|^{_SCRIPT} (?:est|sont) (?:requis|n.{{1,3}}cessaires?|d.{{1,3}}sactiv)|^cette page (?:n.{{1,3}}cessite|requiert|exige) {_SCRIPT}",
    rf"^(?:por favor,? )?(?:active|habilite|activa|habilita|permita) {_SCRIPT}|^su navegador (?:no|est)|^(?:esta p.{{1,3}}gina|este sitio) (?:requiere|necesita) {_SCRIPT}|^se requiere {_SCRIPT}|^(?:es necesario|debe) (?:activar|habilitar) {_SCRIPT}|^{_SCRIPT} (?:es|son) (?:necesari|requerid)",
    r"^请(?:启用|开启|打开|允许) ?(?:javascript|脚本|cookie)|^(?:本|此|该)(?:页面?|网站|站点)需要 ?(?:javascript|脚本|cookie)|^您的浏览器(?:未|不|没|已禁)|^需要(?:启用|开启) ?(?:javascript|脚本)|^请(?:使用|更换|升级)(?:其他|您的)?浏览器",
]
#: Messages of failed pages, services and programs, from the start of a message.
_STATE = r"(?:not found|page not found|forbidden|unauthori[sz]ed|access denied|gone|bad (?:request|gateway)|gateway time-?out|request time-?out|service (?:temporarily )?unavailable|internal server error|too many requests|method not allowed|not acceptable|payment required)"
FAILURES = [
    rf"^{_STATE}[.!]?$",
    rf"^(?:http )?(?:error|status|status code|http)?[ :]*0\s*[-–—:|]?\s*{_STATE}\b",
    rf"^(?:error|http error|http status|status)\s*:?\s*0\s*(?:[-–—:]|$)",
    r'^\{\s*"(?:error|status|code|message|detail)"\s*:.{0,60}"(?:message|detail|error|status|code|reason)"\s*:',
    r"^the requested (?:url|page|resource|file|document)\b.{0,80}(?:was not found|does not exist|(?:could not|cannot|can.t) be (?:found|loaded|opened|served|displayed|reached)|is not available)",
    r"^(?:(?:oops|whoops|sorry|we are sorry|we.re sorry)\b[,:!.]?\s*)(?:something went wrong|we could not find|we couldn.t find|this \w+ is not available|an error|the page|that page|but )",
    r"^something went wrong\b|^we (?:could not|couldn.t) find that (?:page|plate)|^this \w+ is not available right now",
    r"^(?:your session (?:has )?(?:expired|timed out)|you have been signed out|you do not have permission to|request limit reached|sign in again to)",
    r"^traceback \(most recent call last\)|^file \"[^\"]+\", line 0, in |^\w*(?:key|value|type|timeout|runtime|attribute|index|name|import|io|os|connection|zerodivision|assertion|memory|permission|lookup|syntax|reference|range|unicode\w*|filenotfound)error: |^(?:[a-z_]+\.)+\w*(?:exception|error)\b|^(?:warning|notice|fatal error|parse error|deprecated): (?:undefined|division|failed|cannot|can.t|invalid|uncaught|include|call to|array to|trying to|allowed memory|maximum|unexpected|mysql|session)|^exception in thread|^uncaught \w|^caused by: |^at [\w.$]+\([\w.]+:0\)|^stack trace:|^segmentation fault|^null ?pointer ?exception|^core dumped",
    r"^(?:could not|cannot|can.t|unable to|failed to) (?:connect to|reach|load|open|fetch|retrieve|contact|render) the (?:database|server|page|resource|host|site|template|service)\b",
    r"^upstream (?:timed out|connect error|request timeout)|^the (?:connection (?:was reset|timed out|has timed out)|origin took too long|server (?:encountered|is (?:temporarily|too busy|overloaded)|returned an error|did not respond))|^error establishing a database connection|^(?:query|connection|request) failed: |^connection (?:refused|reset|timed out)|^no healthy upstream|^dns_|^err_[a-z_]+",
    r"^(?:the |this )?(?:service|site|page|server|viewer|website|archive) is (?:currently |temporarily )?(?:offline|down|unavailable|under maintenance|not available|closed for maintenance)|^temporarily (?:closed|unavailable|down|offline) (?:for|due)|^(?:down|closed) for (?:scheduled )?maintenance|^scheduled maintenance in progress|^(?:access|permission) denied\s*(?:$|[.:(0])",
    r"^fehler 0\b.{0,8}(?:die|seite|interner|zugriff|dienst)|^es ist ein (?:interner |unerwarteter )?fehler aufgetreten|^(?:die )?(?:angeforderte )?seite (?:wurde )?nicht gefunden|^zugriff verweigert|^(?:ihre )?sitzung (?:ist )?abgelaufen|^bitte melden sie sich erneut an|^(?:der )?dienst (?:ist )?(?:derzeit |vor.{1,3}bergehend )?nicht (?:verf|erreich)|^interner serverfehler|^wegen wartung|^wartungsarbeiten",
    r"^erreur 0 ?[:\-–]|^une erreur (?:interne|inattendue|est survenue|s.est produite)|^(?:la )?page (?:demand.{1,3}e )?(?:est )?(?:introuvable|n.existe pas)|^acc.{1,3}s (?:refus|interdit)|^votre session (?:a|est) expir|^veuillez vous reconnecter|^(?:le )?service (?:est )?(?:temporairement |momentan.{1,3}ment )?indisponible|^site en maintenance|^erreur (?:interne )?du serveur",
    r"^error 0 ?[:\-–] ?|^ha (?:ocurrido|habido) un error|^se ha producido un error|^(?:la )?p.{1,3}gina (?:solicitada )?no (?:existe|encontrada|se encuentra|disponible)|^acceso (?:denegado|prohibido)|^(?:la|su) sesi.{1,3}n (?:ha )?(?:caducado|expirado)|^(?:el )?servicio (?:no disponible|no est.{1,3} disponible|temporalmente)|^sitio en mantenimiento|^error interno del servidor|^inicie sesi.{1,3}n de nuevo",
    r"^(?:服务器(?:内部)?错误|内部服务器错误|系统错误|网络错误)(?!已|被|的|日志|于|在)|^错误 ?0 ?[::]|^(?:错误|出错)[::]|^访问(?:被拒绝|受限)|^会话已?过期|^登录已?(?:过期|失效)|^(?:您|你)?(?:访问|请求)的(?:页面|网页|资源)(?:不存在|未找到|无法)|^(?:页面|网页)(?:不存在|未找到|无法(?:显示|访问)|走丢)|^服务(?:暂时)?不可用|^(?:系统|网站|服务)(?:正在)?维护|^权限不足|^无权访问|^请求(?:超时|过于频繁)|^数据库连接(?:失败|错误)|^抱歉[,, ]*(?:出错|页面|您|服务)",
]
#: Whole messages that a writer could also have used; they count where they recur widely.
SHARED = [
    r"^(?:oops|whoops)[!.]*$",
    r"^thank you for your patience[.!]?$|^please (?:try again later|wait and retry|reload(?: the page)?)[.!]?$|^go back to the start page[.!]?$|^sign in again to continue[.!]?$|^request id 0$",
    r"^(?:bitte )?versuchen sie es (?:sp.{1,3}ter|erneut)|^r.{1,3}essayez plus tard[.!]?$|^vuelva a intentarlo|^int.{1,3}ntelo (?:de nuevo|m.{1,3}s tarde)|^请(?:稍后再试|重新登录|刷新页面)。?$",
    r"^(?:[\p{L} ]{3,30}): ?\?+$",
]


_EDGES = r"^(?:[\s\-•#>=·–—\"'“”‘’«»]|[*|](?!\|)(?<!\*\|))++|(?:[\s\-\"'“”‘’«»]|(?<!\|)[*|](?!\*))++$"


def _where_found(df: DataFrame, marks: tuple[str, ...], pattern: str, by: str) -> DataFrame:
    """``regexp_replace`` in column _t, of the texts that hold one of ``marks``; every match contains one."""
    return df.withColumn("_t", F.when(reduce(or_, (F.contains("_t", F.lit(m)) for m in marks)), F.regexp_replace("_t", pattern, by)).otherwise(F.col("_t")))


def with_messages(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with a row for each distinct message of its text: lines and sentences with masked, folded content.

    What a pattern must contain is looked for first, so that most texts go through few of the patterns.
    """
    df = df.withColumn("_t", text)
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        df = _where_found(df, ("&",), f"(?i){code}", char)
    df = _where_found(df, ("<",), _TAG, "\n")
    df = _where_found(df, ("TK", "NNN", "XX"), r"(?<![\p{IsLatin}\p{N}_.])(?:TK|NNN|XX\.XX|XX(?=[ ]?(?:µm|Âµm|mm|cm|m|%|°)))(?![\p{IsLatin}\p{N}_])", "⟦unfilled⟧")
    df = df.withColumn("_t", F.lower("_t"))
    df = _where_found(df, ("://", "www.", "@"), r"\b(?:https?://|www\.)[^\s<>\"]++|\b[\w.+\-]++@[\w\-]++\.[\w.\-]++", "⟦address⟧")
    df = _where_found(df, ("request id ",), r"(?<=request id )[0-9a-f]++", "0")
    df = df.withColumn("_t", F.regexp_replace("_t", r"\p{N}++(?:[.,:]\p{N}++)*+", "0"))
    df = _where_found(df, ("0-0-0", "0/0/0"), r"0-0-0(?:[t ]0)?|0/0/0", "⟦date⟧")
    df = _where_found(df, ("{", "<", "[", "*"), _TWO_SIDED, "⟦unfilled⟧")
    df = df.withColumn("_t", F.regexp_replace("_t", r"[.!?…]['\"”’)]{0,2}(?=\s)|[。!?]", "$0\n"))
    df = _where_found(df, ("  ", "\t", "\v", "\f"), r"[^\S\r\n]{2,}|[\t\x0B\f]", " ")
    # asterisks and bars at the edges go too, unless they belong to a merge tag
    edge = lambda p: reduce(or_, (f(p, F.lit(c)) for f in (F.startswith, F.endswith) for c in "*|"))
    trimmed = F.transform(F.split("_t", r"[\r\n\x{2028}\x{85}]+"), lambda p: F.rtrim(F.ltrim(p, F.lit(" -•#>=·–—\"'“”‘’«»")), F.lit(" -\"'“”‘’«»")))
    tidy = F.transform(trimmed, lambda p: F.when(edge(p), F.regexp_replace(p, _EDGES, "")).otherwise(p))
    # the generator comes last: what is computed after it would be computed again for every use that a filter makes of it
    return df.withColumn("message", F.explode(F.array_distinct(F.filter(tidy, lambda p: F.length(p) >= 3)))).drop("_t")


def _any(patterns) -> str:
    return "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def _from_start(patterns) -> str:
    """Patterns that all begin with ^, so that no other place is tried."""
    return "^" + _any(patterns)


#: Length of the beginnings that are looked up, and the most alternatives of one place of a beginning.
_BEGIN = 4
_PLACE = 12


def _plain(pattern: str) -> str:
    """The pattern as Python reads it, matching no less: classes of letters or digits become word characters."""
    return re.sub(r"\\p\{\w+\}", r"\\w", pattern)


def _beginnings(items, before: set[str]) -> tuple[set[str], set[str]]:
    """(beginnings that end here, beginnings that may go on) of what the parsed items match after each of ``before``."""
    ended: set[str] = set()
    for op, value in items:
        if op in (parts.AT, parts.ASSERT, parts.ASSERT_NOT):
            continue
        ended |= {b for b in before if len(b) >= _BEGIN}
        before = {b for b in before if len(b) < _BEGIN}
        if not before:
            break
        if op is parts.LITERAL:
            before = {b + chr(value) for b in before}
        elif op is parts.IN and len(value) <= _PLACE and all(o is parts.LITERAL for o, _ in value):
            before = {b + chr(c) for b in before for _, c in value}
        elif op is parts.BRANCH:
            each = [_beginnings(branch, before) for branch in value[1]]
            ended, before = ended.union(*(e for e, _ in each)), set().union(*(o for _, o in each))
        elif op is parts.SUBPATTERN:
            e, before = _beginnings(value[3], before)
            ended |= e
        elif op in (parts.MAX_REPEAT, parts.MIN_REPEAT, parts.POSSESSIVE_REPEAT):
            low, high, inner = value
            reached = before if low == 0 else set()
            for n in range(1, min(high, _BEGIN + 1) + 1):
                e, before = _beginnings(inner, before)
                ended |= e
                if n >= low:
                    reached = reached | before
            before = reached | (before if low > _BEGIN else set())
        else:  # any other place may hold anything
            return ended | before, set()
    return ended, before


def _needles(items) -> set[str] | None:
    """Texts of which every match contains at least one, or None; of several such sets the smallest whose texts have three characters or more, else the smallest."""
    found: list[set[str]] = []
    run = ""
    for op, value in [*items, (None, None)]:
        if op is parts.LITERAL:
            run += chr(value)
            continue
        if op in (parts.MAX_REPEAT, parts.POSSESSIVE_REPEAT) and value[0] and len(value[2]) == 1 and value[2][0][0] is parts.LITERAL:
            found.append({run + chr(value[2][0][1]) * value[0]})
            run = ""
            continue
        if run:
            found.append({run})
            run = ""
        more = None
        if op is parts.IN and len(value) <= _PLACE and all(o is parts.LITERAL for o, _ in value):
            more = {chr(c) for _, c in value}
        elif op is parts.BRANCH:
            each = [_needles(branch) for branch in value[1]]
            more = set().union(*each) if all(each) else None
        elif op is parts.SUBPATTERN:
            more = _needles(value[3])
        elif op in (parts.MAX_REPEAT, parts.MIN_REPEAT, parts.POSSESSIVE_REPEAT) and value[0]:
            more = _needles(value[2])
        if more:
            found.append(more)
    # of equals the last, since sentences end in rarer marks than they begin with
    return max(reversed(found), key=lambda f: (min(map(len, f)) >= 3, -len(f), min(map(len, f)))) if found else None


def _alternatives(items: list) -> list[list]:
    """The parsed items as separate alternatives, where they begin with a choice."""
    at = 1 if items and items[0] == (parts.AT, parts.AT_BEGINNING) else 0
    op, value = items[at] if len(items) > at else (None, None)
    if op is parts.SUBPATTERN:
        op, value = (value[3][0] if len(value[3]) == 1 else (None, None))
    if op is not parts.BRANCH:
        return [items]
    return [x for branch in value[1] for x in _alternatives([*items[:at], *branch, *items[at + 1 :]])]


def cue_of(patterns) -> tuple[set[str], set[str]]:
    """(beginnings, needles): a message that one of ``patterns`` matches begins with one of the former or contains one of the latter."""
    beginnings: set[str] = set()
    needles: set[str] = set()
    for pattern in patterns:
        for branch in _alternatives(list(parser.parse(_plain(pattern)))):
            anchored = bool(branch) and branch[0] == (parts.AT, parts.AT_BEGINNING)
            found = set().union(*_beginnings(branch, {""})) if anchored else {""}
            inside = _needles(branch)
            if "" in found and not inside:
                raise ValueError(f"nothing that every match of {pattern} contains")
            if min(map(len, found)) >= 3 or not inside or min(map(len, inside)) < 3 and "" not in found:
                beginnings |= found
            else:
                needles |= inside
    return beginnings, {n for n in needles if not any(m != n and m in n for m in needles)}


def _shown(message: Column, patterns) -> Column:
    """True at least where one of ``patterns`` matches, at the cost of a few look-ups."""
    beginnings, needles = cue_of(patterns)
    out = F.lit(False)
    for n in sorted({len(b) for b in beginnings}):
        out |= F.substring(message, 1, n).isin(sorted(b for b in beginnings if len(b) == n))
    return reduce(or_, (F.contains(message, F.lit(n)) for n in sorted(needles)), out)


def _repeats_itself(message: Column) -> Column:
    """Filler made of the usual words, of keys side by side, or of the same over and over."""
    latin = F.regexp_count(message, F.lit(_LATIN))
    mash = _shown(message, [_MASH]) & (F.regexp_count(message, F.lit(_MASH)) >= 2)
    return mash | message.rlike(_REPEATED) | (latin >= 4) & (latin * 2 >= F.regexp_count(message, F.lit(r"[\p{L}]+")))


def judge(message: Column, wide: Column) -> Column:
    """Kind of residue that a message is, or null. ``wide``: the message recurs widely."""
    anywhere = _any(PLACEHOLDERS.values())
    quoted = F.regexp_replace(message, r"[`'\"“„«][^`'\"”“»]{1,60}[`'\"”“»]", " ")
    spoken = message.rlike(_SPOKEN_OF) | ~quoted.rlike(anywhere) & message.rlike(r"`")
    holds = F.when(_shown(message, PLACEHOLDERS.values()), message.rlike(anywhere) & ~spoken)
    begins = lambda kind, patterns: F.when(message.rlike(_from_start(patterns)), kind)
    # one look-up for all rules that hold at the beginning: most messages go no further
    phrase = F.when(
        _shown(message, [*FILLER, *NOTICES, *FAILURES, *SHARED]),
        F.coalesce(begins("filler", FILLER), begins("script_notice", NOTICES), begins("failure_message", FAILURES), F.when(wide, begins("shared_message", SHARED))),
    )
    return F.when(holds, "placeholder").when(_repeats_itself(message), "filler").otherwise(phrase)


def judged_messages(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(messages, uses): judged messages with their spread, and the (doc_id, hash) rows that hold a candidate.

    ``messages``: hash, message, kind, n_documents, n_sources. A null source counts as one source.
    """
    uses = (
        documents.where(F.col(text).isNotNull())
        .select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text"))
    )
    uses = (
        with_messages(uses, F.col("text"))
        .select("doc_id", "source", "message")
        .where(judge(F.col("message"), F.lit(True)).isNotNull())  # what no rule matches never leaves its task
        .withColumn("hash", F.md5("message"))
    )
    uses = materialise(uses)
    spread = uses.groupBy("hash", "source").agg(F.count(F.lit(1)).alias("n"), F.min("message").alias("message"))  # combines before the shuffle
    spread = spread.groupBy("hash").agg(F.min("message").alias("message"), F.sum("n").alias("n_documents"), F.count(F.lit(1)).alias("n_sources"))
    wide = (F.col("n_documents") >= WIDE_DOCUMENTS) & (F.col("n_sources") >= WIDE_SOURCES)
    return spread.withColumn("kind", judge(F.col("message"), wide)).where(F.col("kind").isNotNull()), uses


def residue_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, kinds) of the documents that hold residue; kinds is a sorted array.

    Null and empty texts are no cases. Repeated texts count each time; repeated ids give one row with the kinds of
    all their texts. Whole texts are read. An empty table gives no rows; columns other than the three named
    are not read.
    """
    messages, uses = judged_messages(documents, doc_id, text, source)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    spread = messages.select("hash", "kind", salts)
    hits = uses.select("doc_id", "hash", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")).join(spread, ["hash", "salt"])
    return hits.groupBy("doc_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def without_residue(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``documents`` without those that hold residue, all columns kept."""
    return documents.join(residue_documents(documents, doc_id, text, source).select(F.col("doc_id").alias(doc_id)), doc_id, "left_anti")
