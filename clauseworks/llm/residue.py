"""Problem 9: template residue, filler and portal messages in place of content.

Method: mask numbers, addresses and dates of every text, cut it into segments, hash every normalised segment and count the hashes
over all documents and sources. What recurs is classified: a segment with the wording of a message inside, or one that addresses the
reader about scripts, cookies, browsers or servers, is a message from RECURS_DOCS documents on, of one source or of many; a segment
without any such wording that recurs in WIDE_TEXTS different texts of two sources or more, nearly all of which hold a message, is
part of the portal's frame ("back to home"), and so are the documents that hold it without a message that any rule knows. Texts
that are copies of each other count once there, so that what stands beside a message in a document copied often isn't taken for
frame. A placeholder in the place of a value, a template directive, filler, and a segment that begins as a known message are residue
wherever they stand, recurring or not.

Rules read whole texts. Marks in quotation are spoken of, not left over, and are no residue. Null, blank and short genuine texts
are never residue; every row of an input with repeated ids counts once in the result.
"""

from __future__ import annotations

import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import over_batches, settle, widen

#: A message in loose wording counts from this many documents that hold the same masked segment.
RECURS_DOCS = 3
#: A segment without message wording is portal frame from so many different texts of two sources on, if this share of them holds a message.
WIDE_TEXTS, FRAME_SHARE = 10, 0.8

# Forms of placeholders and directives.
_NAME = r"[^\W\d_][\w .\-]{1,38}"
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{1,60}\}\}|\{[#%][^{}\n]{1,60}[#%]?\}|\{%[^\n]{1,60}?%\}|\$\{[^{}\n]{1,40}\}|<%[^\n]{1,60}?%>|<<[^<>\n]{1,40}>>|\[\[[^\[\]\n]{1,40}\]\]"
    rf"|@@{_NAME}@@|\${_NAME}\$|%{_NAME}%|#{_NAME}#|\{{{_NAME}\}}|<(?:{_NAME}|à compléter)>|«{_NAME}»"
    r"|\[(?:…|\.\.\.|[^\W\d_][^\[\]\n]{2,38}|\?+)\]|<!--[^\n]{0,60}?-->"
    r"|_{5,}|\.{6,}|\b[Xx]{4,}\b|\?{3,}"
    r"|\b(?:XX|JJ|DD|TT|GG|MM|AAAA|YYYY|JJJJ)[/.\-](?:XX|MM|JJ|DD)[/.\-](?:XXXX|AAAA|YYYY|JJJJ|YY|AA|XX|DD)\b"
    r"|\b(?:TBD|TODO|FIXME)\b"
)
#: Square brackets and guillemets also serve the text itself (references, labels, quotations): their content decides.
REFERENCE = re.compile(r"^\W*(?:annex|annexe|anhang|anlage|anexo|allegato|see|siehe|voir|véase|vedi|ref|réf|note|table|tableau|tabelle|tabla|tabella|fig|iso)\b", re.I)
QUOTES = "\"'“”„‟‘’‚«»‹›`"
FILLER = re.compile(
    r"(?:\b(?:lorem|ipsum|dolor|dolore|sit|amet|consectetur|adipiscing|elit|sed|eiusmod|tempor|incididunt|labore|magna|aliqua|ut|et|do)\b[\s,.]*){5,}"
    r"|(?:\bbla\b[\s,.\d]*){3,}|(?:\bxxx\b[\s,.\d]*){3,}|(?:\btext\b[\s,.\d]*){4,}|(?:\basdf\w*\b[\s,.\d]*){2,}|(?:\bqwert[yz]\w*\b[\s,.\d]*){2,}|(?:\btest\b[\s,.\d]*){4,}"
    r"|(?:\b(?:texte|texto|testo|blah|dummy|foo|aaa)\b[\s,.\d]*){4,}",
    re.I,
)
# Wording of portal messages, each rule meant for one whole sentence or line.
MESSAGE = re.compile(
    "|".join(
        [
            # filler that asks for its own replacement
            r"^(?:sample|example|dummy) (?:paragraph|text).{0,12}(?:replace|overwrite)",
            r"^paragraphe d'exemple|^párrafo de ejemplo|^paragrafo di esempio|^dies ist ein (?:blindtext|beispieltext)|^(?:beispiel|muster|blind)(?:text|absatz)\b.{0,40}(?:ersetz|eigen)",
            r"^(?:your|votre|ihr|su|il tuo|il vostro) (?:text|texte|texto|testo) (?:goes here|here|ici|hier|aquí|qui)\b",
            r"^(?:hier (?:steht|kommt)|escriba aquí|inserire qui|saisir ici|entrez ici|insert here|geben sie hier|hier eine?n? kurze|introduzca aquí|indicar aquí|describa aquí|inserisci qui|descrivere qui)\b",
            r"^(?:insert|enter|type|add) (?:a|an|the|your) .{0,60}\bhere\b|^(?:insérez|saisissez|décrivez) .{0,40}\bici\b",
            r"^(?:click|cliquez|klicken sie|haga clic|fare clic|zum bearbeiten|hier klicken).{0,20}(?:here|ici|hier|aquí|qui)\b.{0,40}(?:edit|modif|bearbeiten|editar|change|ändern|klicken)?",
            # scripts, cookies, browser checks
            r"^(?:please |you need to |you must |noscript: ?)?(?:enable|turn on|activate|allow) (?:javascript|cookies|scripts)",
            r"^(?:veuillez|merci d'|bitte|por favor|si prega di)? ?(?:activer|aktivieren sie|active|activez|attivare|activar|habilite|abilitare) (?:javascript|les cookies|cookies|las cookies|i cookie)",
            r"^this (?:portal|site|page|application) (?:requires|needs) (?:scripts|javascript|cookies)",
            r"^(?:ce portail|cette page|ce site) (?:nécessite|requiert) .{0,30}(?:scripts?|javascript|cookies)|^dieses portal benötigt (?:skripte|javascript|cookies)|^diese (?:seite|anwendung) benötigt (?:skripte|javascript|cookies)",
            r"^(?:este portal|esta página) (?:necesita|requiere) (?:scripts|javascript|cookies)|^(?:questo portale|questa pagina) richiede (?:script|javascript|cookie)",
            r"cookies? (?:et|and|und|y|e) (?:les |las |gli |i )?(?:scripts?|skripte|javascript) .{0,60}(?:pour lire|to read|um dieses|para leer|per leggere|zum lesen)",
            r"(?:cookies|skripte) (?:und|oder) (?:skripte|cookies) .{0,40}(?:dokument|lesen|erlaub|zulassen|zugelassen)|(?:debe|deben|necesita|hay que) .{0,20}(?:permitir|habilitar|activar) .{0,12}(?:cookies|scripts)|occorre .{0,20}(?:abilitare|consentire|attivare) .{0,12}(?:cookie|script)",
            r"^your browser does not support|^votre navigateur ne|^ihr browser unterstützt|^su navegador no|^il (?:suo|vostro|tuo) browser non",
            r"^checking your browser|^vérification de votre navigateur|^(?:ihr browser wird|überprüfung ihres browsers|browserprüfung)|^(?:comprobando|verificando) su navegador|^(?:verifica|controllo) del (?:suo |vostro )?browser",
            # access and session
            r"^(?:access denied|accès refusé|zugriff verweigert|acceso denegado|accesso negato)\W*$",
            r"^(?:you do not have|you don't have) (?:permission|access|the rights)|^vous n'avez pas (?:les droits|l'autorisation|la permission)|^sie haben keine berechtigung|^no tiene (?:permiso|autorización|derechos)|^non (?:si dispone|dispone|hai|avete).{0,12}(?:permess|autorizz|diritt)",
            r"^your session has (?:expired|timed out)|^votre session a expiré|^ihre sitzung ist abgelaufen|^su sesión ha (?:caducado|expirado)|^la (?:sua |vostra )?sessione è scaduta",
            r"^please (?:sign|log) in again",
            # errors and missing pages
            r"^the (?:page you (?:are looking for|requested)|requested (?:document|page|file)) (?:has been|could not|was not|cannot|is not)",
            r"^la page que vous (?:recherchez|demandez)|^le document demandé (?:est|n'a|n'est)|^die (?:gesuchte|angeforderte) seite|^das angeforderte dokument|^la página (?:que busca|solicitada)|^el documento solicitado|^la pagina (?:cercata|richiesta)|^il documento richiesto",
            r"^(?:error|erreur|fehler|errore) 0 ?[:–-]|^0 ?[-–:]? ?(?:internal server error|bad gateway|not found|forbidden|service unavailable|gateway time-?out|page not found)|^(?:internal server error|bad gateway|not found|gateway time-?out)\b",
            r"^(?:erreur interne du serveur|interner serverfehler|error interno del servidor|errore interno del server)",
            r"^(?:service|dienst|servicio|servizio) (?:temporarily|momentanément|temporairement|vorübergehend|derzeit|momentanea|temporal|temporanea)\w* (?:unavailable|indisponible|nicht verfügbar|no disponible|non disponibile)",
            r"^(?:sorry|oops|oups|ups|désolé|leider|lo sentimos|spiacenti)\b.{0,12}(?:something went wrong|une erreur|ist ein fehler|ha ocurrido|si è verificato|error|fehler)",
            r"^(?:error while|échec du|fehler beim|error al|errore durante) .{0,20}(?:loading|chargement|laden|cargar|caricamento)",
            r"^traceback \(most recent call last\)|^(?:key|value|type|index|attribute|name|runtime)error: |^\w+(?:\.\w+)+\.?\w*(?:exception|error|fault): |^at \w+(?:\.\w+){2,}\(\w+\.java:0\)|^file \"[^\"]+\", line 0, in |^(?:warning|notice|fatal error): .{0,80} in /\S+ on line 0",
            r"^please try again later|^merci de réessayer|^bitte versuchen sie es später|^inténtelo (?:de nuevo )?más tarde|^riprovare più tardi",
        ]
    )
)
#: The same wording anywhere in a segment: it must also recur.
PHRASE = re.compile(re.sub(r"(^|\|)\^", r"\1\\b", MESSAGE.pattern))
#: Loose wording: the masked segment must also recur.
LOOSE = re.compile(r"\b(?:javascript|cookies?|scripts?|browser|navigateur|navegador|server|serveur|servidor)\b", re.I)
ADDRESSES = re.compile(r"\b(?:please|your|veuillez|merci de|votre|vos|bitte|ihre?[mnrs]?|por favor|sus?|si prega|(?:il )?(?:tuo|suo|vostro))\b", re.I)
SPEAKS = re.compile(r"\b(?:auditor|auditeur|workstations?|postes|arbeitsplätzen|puestos|postazioni|terminal|operator|opérateur|forms?|fiches|badge|model|edition|édition)\b", re.I)
# Characters and words of which one stands in every placeholder, filler and message rule. A text without any isn't looked at further.
_MARKS = ("{", "<", "[", "@@", "$", "%", "#", "«", "_____", "......", "???", "XXXX", "xxxx", "XX/", "XX.", "XX-", "JJ/", "JJ.", "JJ-", "DD/", "DD.", "DD-", "TT/", "TT.", "TT-", "GG/", "GG.", "GG-", "MM/", "MM.", "MM-", "AAAA", "YYYY", "TBD", "TODO", "FIXME")
_FILLERS = {"ipsum": 1, "dolor": 1, "bla": 3, "xxx": 3, "text": 4, "asdf": 2, "qwert": 2, "test": 4, "dummy": 4, "foo": 4, "aaa": 4}  # and how often at least
_TRIGGERS = (
    "javascript", "cookie", "server", "serveur", "servidor", "script", "skript", "richiede script", "browser", "navigateur", "navegador", "access denied", "accès refusé", "zugriff verw", "acceso denegado", "accesso negato", "do not have", "don't have",
    "n'avez pas", "keine berechtigung", "no tiene perm", "no tiene auto", "no tiene derech", "non si dispone", "non dispone", "non hai", "non avete", "your session", "votre session", "sitzung ist", "su sesión", "sessione è", "sessione e", "sign in again", "log in again", "page you", "requested",
    "page que vous", "document demandé", "angefordert", "gesuchte", "solicitad", "página que busca", "cercata", "richiest", "error", "erreur", "fehler", "gateway", "not found", "forbidden", "unavailable", "indisponible", "nicht verfügbar", "no disponible", "non disponibile", "sorry", "oops", "oups", "ups,", "désolé", "leider",
    "lo sentimos", "spiacenti", "échec du", "traceback", "fault:", ".java:", "on line", "exception:", "try again", "réessayer", "versuchen sie", "más tarde", "più tardi", " here", "paragraphe d'exemple", "ejemplo", "esempio", "blindtext", "beispiel", "muster", "replace", "texte ici", "text ici", "ihr text",
    "zum bearbeiten", "klicken sie", "escriba aquí", "introduzca aquí", "indicar aquí", "describa aquí", "haga clic", "fare clic", "inserire qui", "inserisci qui", "descrivere qui", "saisir ici", "entrez ici", "cliquez ici", "insérez", "saisissez", "décrivez", "text hier", "texto aquí", "testo qui", "hier ein", "hier steht", "hier kommt",
)


def _automaton(words):
    try:
        import ahocorasick
    except ImportError:
        return lambda text: any(w in text for w in words)
    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w, w)
    a.make_automaton()
    return lambda text: next(a.iter(text), None) is not None


@functools.cache
def _finders():
    return _automaton(_MARKS), lambda text: any(text.count(w) >= n for w, n in _FILLERS.items()), _automaton(_TRIGGERS)


_SPLIT = re.compile(r"[\r\n]+|(?<=[.!?])[ \t]+")
_ADDRESS = re.compile(r"(?:https?://|www\.)\S+|\S+@\S+\.\w+")
_DATE = re.compile(r"\b\d{1,4}[./-]\d{1,2}[./-]\d{1,4}\b")
_NUMBER = re.compile(r"\d+")


def mask(text: str) -> str:
    """Lower case, with addresses, dates and numbers masked."""
    return _NUMBER.sub("0", _DATE.sub("<date>", _ADDRESS.sub("<addr>", text.lower().replace("’", "'"))))


def normalise(segment: str) -> str:
    """A segment masked, with white space collapsed."""
    return " ".join(mask(segment).split())


def segments(masked: str) -> list[str]:
    """The lines and sentences of a masked text, without bullets and outer blanks."""
    parts = (" ".join(x.strip(" \t*-•#>|").split()) for x in _SPLIT.split(masked))
    return [x for x in parts if x]


def placeholder_in(text: str) -> bool:
    """A placeholder or directive that isn't put in quotation marks, nor a bracketed reference of the text."""
    for m in PLACEHOLDER.finditer(text):
        found = m.group()
        before, after = text[: m.start()].rstrip(" \u00a0\u202f\u2009")[-1:], text[m.end() :][:2].lstrip(" \u00a0\u202f\u2009")[:1]
        if before and after and before in QUOTES and after in QUOTES:
            continue
        if found[0] in "[<" and found[1:2] not in "[<%!" and REFERENCE.match(found[1:-1]):
            continue
        if found[0] == "[" and text[m.end() : m.end() + 1] == "(":  # a link
            continue
        return True
    return False


def filler_in(text: str) -> bool:
    return FILLER.search(text) is not None


def findings(text: str) -> list[tuple[str, str, bool]]:
    """(kind, masked segment, certain) of one text: what stands in it in place of content."""
    return _judge(text, mask(text))[0]


def _judge(text: str, masked: str) -> tuple[list[tuple[str, str, bool]], list[str]]:
    out, parts = [], segments(masked)
    marks, fillers, triggers = _finders()
    low = text.lower()
    if marks(text) and placeholder_in(text):
        out.append(("placeholder", "", True))
    if fillers(low) and filler_in(low):
        out.append(("filler", "", True))
    if triggers(masked):
        for s in parts:
            if not triggers(s):
                continue
            if MESSAGE.search(s):
                out.append(("message", s, True))
            elif (LOOSE.search(s) and ADDRESSES.search(s) or PHRASE.search(s)) and not SPEAKS.search(s):
                out.append(("message", s, False))
    return out, parts


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_FINDINGS = pa.list_(pa.struct([("kind", pa.string()), ("segment_hash", pa.int64()), ("segment", pa.string()), ("certain", pa.bool_())]))
SCANNED = "doc_id long, source string, text_hash long, segments array<long>, findings array<struct<kind:string,segment_hash:long,segment:string,certain:boolean>>"


def _scan(batches):
    for b in batches:
        ids, sources, texts, parts, rows = [], [], [], [], []
        for i, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if not text or i is None:
                continue
            found, own = _judge(text, mask(text))
            ids.append(i)
            sources.append(source)
            texts.append(_hash(text))
            parts.append(list({_hash(s) for s in own}))
            rows.append([{"kind": kind, "segment_hash": _hash(s), "segment": s, "certain": sure} for kind, s, sure in sorted(set(found))])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sources, pa.string()), pa.array(texts, pa.int64()), pa.array(parts, pa.list_(pa.int64())), pa.array(rows, _FINDINGS)], ["doc_id", "source", "text_hash", "segments", "findings"])


def scanned(documents: DataFrame) -> DataFrame:
    """doc_id, source, text_hash, segments, findings of documents(doc_id, source, text): the hashes of all masked segments, and what the rules find."""
    rows = documents.select("doc_id", F.lower(F.regexp_replace(F.trim("source"), "-", "_")).alias("source"), "text")
    return settle(over_batches(widen(rows).filter("doc_id is not null"), _scan, SCANNED), "residue_scan")


def suspects(scan: DataFrame) -> DataFrame:
    """doc_id, source, kind, segment_hash, segment, certain: every suspicious segment."""
    return scan.select("doc_id", "source", F.inline("findings"))


def recurring_messages(found: DataFrame) -> DataFrame:
    """segment_hash, segment, n_docs, n_sources, certain of each masked message, counted over all documents."""
    return (
        found.filter(F.col("kind") == "message")
        .groupBy("segment_hash", "doc_id")
        .agg(F.min("segment").alias("segment"), F.max("certain").alias("certain"), F.min("source").alias("source"))
        .groupBy("segment_hash")
        .agg(F.min("segment").alias("segment"), F.count("*").alias("n_docs"), F.approx_count_distinct("source", 0.02).alias("n_sources"), F.max("certain").alias("certain"))
    )


def portal_frame(scan: DataFrame) -> DataFrame:
    """segment_hash, n_texts, n_messages: segments that recur widely and almost only in texts that hold a message; every segment of every different text is counted."""
    message = F.exists("findings", lambda x: (x["kind"] == "message") & x["certain"])
    texts = scan.groupBy("text_hash").agg(F.first("segments").alias("segments"), F.max(message.cast("int")).alias("message"), F.min("source").alias("source"), F.max("source").alias("last"))
    counts = texts.select(F.explode("segments").alias("segment_hash"), "message", "source", "last").groupBy("segment_hash").agg(F.count("*").alias("n_texts"), F.sum("message").alias("n_messages"), F.min("source").alias("source"), F.max("last").alias("last"))
    wide = (F.col("n_texts") >= WIDE_TEXTS) & (F.col("n_messages") >= FRAME_SHARE * F.col("n_texts")) & (F.col("source") < F.col("last"))
    return counts.filter(wide).select("segment_hash", "n_texts", "n_messages")


def detect_residue(documents: DataFrame) -> DataFrame:
    """doc_id, kinds: the documents that hold residue, each once, with the kinds found (sorted): filler, frame, message, placeholder, recurring."""
    scan = scanned(documents)
    found = suspects(scan)
    known = recurring_messages(found).filter(F.col("certain") | (F.col("n_docs") >= RECURS_DOCS)).select("segment_hash")
    direct = found.filter("certain").select("doc_id", "kind")
    loose = found.filter("not certain").join(known, "segment_hash", "left_semi").select("doc_id", F.lit("recurring").alias("kind"))
    frame = scan.select("doc_id", F.explode("segments").alias("segment_hash")).join(portal_frame(scan).join(known, "segment_hash", "left_anti").select("segment_hash"), "segment_hash", "left_semi").select("doc_id", F.lit("frame").alias("kind"))
    return direct.unionByName(loose).unionByName(frame).groupBy("doc_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def without_residue(documents: DataFrame) -> DataFrame:
    """The documents that hold none, all columns kept."""
    return documents.join(detect_residue(documents).select("doc_id"), "doc_id", "left_anti")
