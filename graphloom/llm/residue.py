"""Template residue, filler, error pages and script notices in texts.

Texts are cut into normalised lines, which are counted by host over its different texts.  A host's recurrent lines,
whatever they say, are taken off first; then what is left of a text is searched for evidence.  A value left unfilled is
evidence anywhere in it; the other kinds count only where they are what is left of the text, so that reports about such
things stay.  Evidence is told by general forms: the delimiters of a template's places, a status code or a thing of
the web with what is wrong with it, a call to switch scripts on, and shares of filler vocabulary.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut

RECURRENT = 3  # different texts of one host that hold a line before it is boilerplate
RECURRENT_SHARE = 0.005  # and the share of the host's different texts
REST_WORDS = 30  # words beside the evidence that an error page or a notice may hold
FILLER_SHARE = 0.6  # least share of filler in what is left of a text
STATEMENT = 25  # words of a sentence that states an error
HEADING = 8  # words of one that leaves the article out

# ---- Fixed values: word lists of the forms, by language (English, German, French, Spanish) ----
TAGS = "a abbr article aside b base blockquote body br button caption cite code col dd del details div dl dt em fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins label li link main meta nav noscript ol option p pre q script section select small span strong style sub sup table tbody td textarea tfoot th thead title tr u ul".split()
QUOTES = r"tokens?|templates?|placeholders?|parser|exporter|replaces?|replaced|stands? for|syntax|variables?|markers?|notation|platzhalter|vorlage|modèle|plantilla|marcador"
FIELDS = r"(?:(?:first|last|full|user|company|your|insert|enter|add|order|customer|client|vor|nach) ?)?(?:name|date|title|company|address|city|country|e-?mail|phone|amount|number|signature|owner|subject|price|url|link|text|id|datum|firma|adresse|ort|betrag|nom|prénom|ville|montant|nombre|apellido|fecha|ciudad|importe)"
ARTICLES = r"the|this|that|your|our|die|der|das|diese[rsnm]?|ihre?|unsere?|la|le|les|cette|cet|ce|votre|notre|el|los|las|esta|este|su|tu|nuestr[oa]"
THINGS = (
    r"(?:web ?)?(?:page|site)|url|link|address|resource|file|server|service|host|request|operation|connection|session|gateway|access|permission|application|app|endpoint|domain|database|content|browser|account|licen[cs]e|quota"
    r"|(?:web|start|ziel)?seite|website|dienst|ressource|adresse|anfrage|verbindung|sitzung|datei|datenbank|zugriff|zugang|inhalt|konto"
    r"|serveur|lien|requête|connexion|fichier|accès|contenu|opération|délai|compte|página|sitio|servidor|servicio|recurso|dirección|enlace|solicitud|operación|conexión|sesión|archivo|acceso|contenido|cuenta"
)
WRONG = (
    r"not (?:be )?(?:found|reach\w*|load\w*|display\w*|open\w*|process\w*|complet\w*|serv\w*|respond\w*|exist|available|allowed|permitted|authori[sz]ed|valid|supported)"
    r"|(?:is|was|does|did|could|can|are)n['’]t\b|cannot be|no longer|unavailable|unreachable|timed out|expired|denied|refused|forbidden|failed|reset by|offline|(?:is|are|currently|temporarily) down|under (?:maintenance|construction)|(?:has|have) been (?:moved|removed|deleted|blocked|disabled)|overloaded|broken|restricted|suspended|locked|exceeded|invalid|missing|did not (?:receive|answer|respond|load|finish|complete)|out of date|took too long|needs? you to (?:log|sign) in"
    r"|nicht (?:gefunden|verfügbar|erreichbar|geladen|mehr|möglich|erlaubt|gestattet|angezeigt|existiert)|existiert nicht|antwortet nicht|(?:konnte|kann)\b.{0,30}\bnicht|abgelaufen|verweigert|gesperrt|eingeschränkt|fehlgeschlagen|wartung\w*|unterbrochen|zu lange gebraucht|veraltet|ungültig|überschritten|(?:wurde|ist) (?:\w+ )?(?:entfernt|gelöscht|verschoben|deaktiviert)"
    r"|introuvable|non trouvée?|n['’](?:existe|est) (?:pas|plus)|n['’]a (?:pas|pu)|ne répond|indisponible|inaccessible|refusée?|interdite?|restreinte?|expirée?|dépassée?|suspendue?|invalide|(?:a|été) (?:supprimée?|déplacée?|désactivée?)|a été (?:supprimée?|déplacée?)|échoué|en maintenance|en construction"
    r"|no (?:se )?(?:encontr\w+|existe|está|disponible|responde|pudo|puede|ha)|ya no|denegad[oa]|restringid[oa]|suspendid[oa]|inválid[oa]|(?:ha sido|fue) (?:eliminad[oa]|movid[oa])|ha (?:expirado|caducado)|prohibid[oa]|caducad[oa]|expirad[oa]|caducado|fallado|en mantenimiento|en construcción|fuera de servicio"
)
REASONS = r"bad request|unauthori[sz]ed|payment required|forbidden|not found|(?:authori[sz]ation|authentication) required|method not allowed|not acceptable|request time-?out|conflict|gone|too many (?:requests|redirects)|internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|access denied|permission denied"
ERROR_WORD = r"error|erreur|fehler|errore?|status|statut|estado"
EXCUSES = r"oops|whoops|uh[- ]?oh\b|unable to (?:load|open|find|connect|reach|display|process|complete|access|retrieve)\b|impossible (?:de |d['’])\w+er\b|(?:request |connection )?time-?out\b\W*$|zeitüberschreitung|(?:se agotó|agotado) el tiempo|délai d['’]attente|(?:internal|interner|interne[rs]?|interno) (?:server )?(?:error|fehler|erreur)\b|(?:erreur|error) intern[eo]\b|(?:we(?:['’]re| are) (?:currently )?(?:experiencing|having)|nous rencontrons|wir haben (?:derzeit|zurzeit))\b.{0,40}\b(?:technical|difficult\w*|problems?|trouble|techniques?|probleme)\b|bitte versuchen sie es\b|veuillez réessayer|(?:por favor )?inténtelo\b|(?:we(?:['’]ll| will) )?be (?:right )?back (?:soon|shortly|later)?\W*$|(?:error|failed|failure) (?:while|when|to|loading|fetching|processing|reading)\b|fehler (?:beim|bei der)|erreur (?:lors|de (?:chargement|connexion))|error al\b|(?:we(?:'re| are) )?sorry\b.{0,40}\b(?:error|wrong|page|site|find|access|available|blocked|problem)|something (?:went wrong|broke|is broken)|(?:please )?try again later|scheduled (?:downtime|maintenance)|an? (?:\w+ ){0,2}(?:error|exception) (?:has )?occurred|es ist ein (?:\w+ )?fehler|(?:ein|der) (?:\w+ )?fehler ist|une erreur (?:\w+ )?(?:est|s['’]est)|(?:se )?ha(?: ocurrido| producido|y) un error|(?:ein|das) problem (?:ist|mit)|un problème (?:est|s['’]est)|ha (?:ocurrido|surgido) un problema|(?:you|vous|sie|usted|debe) ?(?:must|need to|devez|müssen|iniciar)\b.{0,30}\b(?:log(?:ged)? ?in|sign(?:ed)? in|connectée?|anmelden|angemeldet|sesión)\b|there (?:is|was) (?:a|an) (?:problem|error) (?:with|while|in)|votre session|(?:su|tu) sesión|ihre sitzung"
UNABLE = r"(?:we|you)(?:['’]re| are| were| have| do| could| can)?(?: ?n['’]?o?t|not)?\b.{0,20}\b(?:find|finding|load|loading|access|reach|display|permission|allowed|authori[sz]ed|blocked)\b.{0,30}?(?:\b(?:this|that|the (?:requested )?(?:page|site|url|server|resource|file)|what you)\b|\W*$)|sie (?:haben|sind|dürfen)\b.{0,40}\b(?:nicht|keine?n?)\b.{0,40}\b(?:berechtig\w*|zugriff|zugang|erlaub\w*|seite)|vous n['’](?:avez|êtes) pas\b.{0,30}\b(?:accès|autoris\w*|permission|droit\w*)|no (?:tiene|dispone)\b.{0,30}\b(?:permiso|acceso|autoriza\w*)|no se (?:pudo|puede|ha podido)\b.{0,20}\b(?:cargar|mostrar|acceder|encontrar|abrir)"
CRASHES = r"traceback \(most recent|file \".{1,200}\", line \d+|raise \w+|(?:[\w.]+\.)?\w*(?:error|exception): |at [\w$.]+\([\w.:]+\)|<error><code>|sqlstate\W|(?:fatal|uncaught|unhandled|syntax|parse|runtime) (?:\w+ )?(?:error|exception)\b|[\w.]*\w(?:error|exception) (?:at|in) |(?:fatal|panic|critical|failure|emerg)\b\W?: |(?:nginx|apache|httpd|curl|ssh|mysql|psql|docker|kernel)\W{1,2}.{0,80}\b(?:timed out|refused|failed|denied|reset|unreachable)\b|segmentation fault|core dumped|\{.{0,300}\"(?:status|code|error|errors|message)\"\s*:.{0,300}\}\W*$"
SCRIPTS = r"java ?-?scripts?|js|(?:client-side )?script(?:s|ing)?|skripte?"
SWITCH_ON = r"must have|you need|necesit\w+ tener|devez avoir|müssen|enabl\w+|activat\w+|turn(?:ing)? on|switch(?:ing)? on|allow\w*|requires?|needs?|aktivier\w+|einschalten|erlauben|benötigt|erfordert|activez|activer|active|autoris\w+|nécessite|exige|requiert|habilit\w+|permit\w+|requiere|necesita"
NEEDED_OR_OFF = r"must be|(?:is|are|has|have) (?:been )?(?:required|needed|disabled|deactivated|blocked|switched off|turned off|off|not (?:enabled|available|supported))|(?:ist|sind|wird|werden|muss)\b.{0,20}\b(?:deaktiviert|erforderlich|benötigt|aktiviert|ausgeschaltet|blockiert)|deaktiviert|erforderlich|aktivieren|zulassen|(?:est|sont|doit|doivent)\b.{0,20}\b(?:désactivé|requis|nécessaire|activé|bloqué)|désactivé|requis|(?:ausgeschaltet|abgeschaltet)|(?:es|está|debe)\b.{0,20}\b(?:necesario|desactivado|obligatorio|activado|habilitado|bloqueado)|necesario|desactivado"
BROWSER_CHECK = r"checking your browser|(?:just a|one) moment\W.{0,40}\b(?:verif|check|browser|connect|redirect)|verifying (?:your|the) (?:connection|request|session|device)|verify(?:ing)? (?:that )?(?:your browser|you(?:['’]re| are) (?:a )?(?:human|not a robot))|please wait\b.{0,30}\b(?:browser|redirect\w*|verif\w*)|(?:loading|laden|chargement|cargando)(?:\.\.\.|…)\W*$"
FILLER_KIND = r"placeholder|dummy|filler|sample|example|blind|beispiel|platzhalter|füll|muster|provisoire|factice|faux|de remplissage|d['’]exemple|de relleno|de ejemplo|provisional|de prueba"
FILLER_ALONE = r"placeholder|dummy|filler|platzhalter"
FILLED = r"text[eo]?|copy|content|description|paragraph|title|heading|image|picture|inhalt|beschreibung|titel|absatz|contenu|titre|paragraphe|contenido|descripción|título|párrafo"
HERE = r"here|below|hier|ici|aquí|in this (?:box|space|field|section)"
TO_COME = r"coming soon|to (?:be (?:written|added|done|defined|announced|completed|confirmed)|come)|folgt|à (?:compléter|venir)|pendiente|próximamente|por definir"
REPLACE = r"(?:bitte )?(?:replace|insert|enter|type|write|add|put|edit|provide|ersetzen|schreiben|einfügen|eingeben|remplace[rz]?|insére[rz]|saisi\w+|écrivez|ajoute[rz]|sustituya|reemplace|inserte|escrib[ae]|añad[ae])\b"
LOREM = set(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vivamus vestibulum praesent pellentesque suspendisse curabitur maecenas phasellus fusce donec etiam integer mauris morbi nam nunc proin quisque aenean aliquam turpis lacus arcu cursus nibh mattis ornare semper ligula justo porta tortor felis neque purus vitae massa quam risus nomen sagittis sagit vel lectus leo metus mi nec orci pede porttitor pulvinar rhoncus sapien sem tellus tincidunt ultrices urna varius vulputate vellat perspiciatis unde omnis iste natus error accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis architecto beatae dicta explicabo nemo ipsam quia voluptas aspernatur odit aut fugit consequuntur magni dolores eos ratione sequi nesciunt".split()
)
MASH = set("asdf asdfg asdfgh dfgh qwer qwert qwerty qwertz jkl jklo hjkl yxcv zxcv foo bar baz qux xxx xx xxxx test blah bla tbd tba lorem".split())
# ---- End of fixed values ----

_PLACE = r"[\w.\- ]{1,40}"
PLACEHOLDER = re.compile(
    rf"\{{\{{\s*{_PLACE}\}}\}}|[$#]\{{{_PLACE}\}}|\[\[\s*{_PLACE}\]\]|<<\s*{_PLACE}>>|<%=?[^%<>\n]{{1,60}}%>|\{{%[^%{{}}\n]{{1,60}}%\}}|\*\|{_PLACE}\|\*"
    rf"|%[A-Z][A-Z0-9_.]{{1,40}}%|#[A-Z][A-Z0-9_.]{{1,40}}#|\$[A-Z][A-Z0-9_.]{{1,40}}\$|__[A-Z][A-Z0-9_.]*[A-Z0-9]__|@@{_PLACE}@@|«[a-z][a-z_.]{{1,30}}»"
    r"|\{(?:\d{1,2}|[A-Za-z][\w.]{1,30})\}|\[object Object\]|\((?:[\w.]+ ){0,4}to be (?:added|completed|defined|filled in|confirmed)\)"
    rf"|(?i:\[(?:insert|enter|add|fill in|todo|tbd|your|ihre?|votre|su)\b[^\[\]\n]{{0,40}}\]|\[{FIELDS}(?:[ ,/]+{FIELDS})*\])|\b(?:FIRST|LAST|FULL|USER|COMPANY)_?NAME\b"
    rf"|(?<!\S)%(?:\(\w{{1,30}}\))?[sd](?![\w%])|(?<!\S):[a-z]+_[a-z_]{{1,30}}\b|(?<!\S)\$[a-z]+_[a-z_]{{1,30}}\b"
    r"|(?<=[^\W_])[ :]+_{4,}|_{4,}(?=[ ,.;][^\W_]| - )|<(?!(?:" + "|".join(TAGS) + r")\b)[A-Za-z][\w. ]{1,40}>"
)
MARK = re.compile(r"[{$\[<*%#@«]|__|\bto be |(?<!\S):[a-z]|NAME\b")  # every match of PLACEHOLDER holds one
QUOTING = re.compile(rf"(?i)\b(?:{QUOTES})\b")
_DONE = rf"(?:{FILLED})\b(?:\W+\w+){{0,2}}?\W+(?:goes |steht |stehen |va )?(?:{HERE}|{TO_COME})"
# These are matched with lower-cased sentences.
FILLER = re.compile(
    rf"^\W*(?:(?:this|dies|hier|ceci|esto) (?:is|ist|steht|est|es) )?(?:(?:an?|the|eine?|der|un|une|el)\W+)?(?:(?:example|body|image|picture|page|product) )?(?:"
    rf"(?:{FILLER_KIND})[ -]?(?:{FILLED})\b(?! of\b)|(?:{FILLER_ALONE})\b(?! of\b)|(?:{FILLED}) (?:{FILLER_KIND})\b|(?:your|ihre?|votre|su|tu|main|short|more)?\W*{_DONE}"
    rf"|(?:{HERE}) (?:steht|folgt|kommt|könnte|votre|va)\b|(?:your|ihre?|votre|su|tu) \w+ (?:{HERE})|(?:\w+ ){{1,2}}goes (?:{HERE})|(?:{TO_COME})\W*$"
    rf"|{REPLACE}\W+(?:\w+\W+){{0,6}}?(?:{FILLED}|summary|details|message|bio|name|information)\b(?:\W+\w+){{0,4}}?\W+(?:{HERE})\W*$|{REPLACE}\W+(?:{HERE})\W+(?:your|ihre?n?|votre|su|tu)\b|(?:wird|werden) (?:\w+ ){{0,2}}?(?:ersetzt|ergänzt|eingefügt)\W*$|(?:will|to) be replaced\b|{REPLACE}\W+(?:(?:this|the|your|own|ce|cet?te|le|este|el|die|den|diesen|some|in)\W+)?(?:\w+\W+){{0,2}}?(?:{FILLED}|block\w*|bloque|bloc|something)\b|(?:write|add) (?:something|your own)|(?:bitte )?(?:durch den echten|ersetzen)"
    rf"|er (?:dient|wird)|(?:this is )?a test\W*$|this is (?:only )?a test\b|please ignore|tbd\b|tba\b|todo\b|heading \d+|x+(?: x+)+|(?:ceci est|esto es) un"
    rf")"
)
ERROR = re.compile(
    rf"^\W*(?:https?(?:/[\d.]+)?\W{{0,3}}[45]\d\d\b|(?:https?\W{{0,3}})?(?:{ERROR_WORD})\W{{0,3}}(?:code\W{{0,3}})?[45]\d\d\b|error \d{{3,5}}\b|[45]\d\d\W{{1,3}}(?:{REASONS}|{ERROR_WORD})\b|(?:{REASONS})\W*$|(?:{EXCUSES})|(?:hmm\W+)?(?:{UNABLE})|(?:{CRASHES}))"
)
STATED = re.compile(rf"^\W*(?:(?:sorry|unfortunately|leider|désolé|lo sentimos)\W+)?(?P<art>(?:{ARTICLES})\W+|l['’])?(?:requested |angeforderte |gewünschte )?(?:[^\W\d_]+ )?(?:{THINGS})\b(?! (?:of|between|from|du|des|der|del|de la|de l)\b)(?:\W+[^\W\d_]\w*['’]?){{0,7}}?\W+(?:{WRONG})\b")
SCRIPT_WORD = re.compile(rf"\b(?:{SCRIPTS})\b")
SCRIPT = re.compile(rf"\b(?:{SWITCH_ON})\b.{{0,40}}\b(?:{SCRIPTS})\b|\b(?:{SCRIPTS})\b.{{0,40}}?\b(?:{NEEDED_OR_OFF})\b|^(?:without|ohne|sans|sin) (?:{SCRIPTS})\b|\b(?:without|ohne|sans|sin) (?:{SCRIPTS})\W*$|\bworks? (?:best|only|better) with (?:{SCRIPTS})\b|\b(?:browser|navigateur|navegador)\b.{{0,30}}\b(?:block\w*|bloque\w*|blockiert|(?:does not|doesn['’]t|cannot) (?:run|support)|ne prend pas en charge|unterstützt|no (?:admite|soporta))\b.{{0,20}}\b(?:{SCRIPTS})\b")
WAITING = re.compile(rf"^\W*(?:{BROWSER_CHECK})")
LATIN_END = ("us", "um", "is", "it", "at", "or", "ur", "em", "am", "ae", "que", "nt", "bus", "io", "i", "a", "e", "o")

INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
ENTITY = re.compile(r"&(lt|gt|amp|quot|#39|nbsp);")
ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "#39": "'", "nbsp": " "}
TAG = re.compile(r"</?(?:" + "|".join(TAGS) + r")\b[^<>]{0,200}>", re.I)
FIELD_TAG = re.compile(r"<(title|summary|caption|label|code|address)>", re.I)
SENTENCE = re.compile(r"(?<=[.!?…])\s+")
WORD = re.compile(r"[^\W_]+")
NAVIGATION = re.compile(r"^[^|:\d]{1,40}(?:\|[^|:\d]{1,40}){2,}$")
DIGIT = re.compile(r"\d")
KINDS = ("unfilled", "filler", "error", "script", "rest")


def latin(words: list[str]) -> bool:
    """Whether words are filler Latin: six in ten of its vocabulary, or a quarter with nearly all others ending as Latin does."""
    known = sum(w in LOREM for w in words)
    return known >= 0.6 * len(words) or len(words) >= 5 and known >= 0.25 * len(words) and sum(w in LOREM or w.endswith(LATIN_END) for w in words) >= 0.9 * len(words)


def line_evidence(line: str, low: str) -> tuple[int, int, int, int, int]:
    """Unfilled values of a line (``low`` is its lower case), and its words of filler, of errors, of script notices, and others."""
    unfilled = filler = error = script = rest = 0
    marked = MARK.search(line) is not None
    scripts = "script" in low or "skript" in low or "js" in low  # as every SCRIPT_WORD holds
    for k, lowered in enumerate(SENTENCE.split(low)):
        if marked:
            sentence = SENTENCE.split(line)[k]
            marks = PLACEHOLDER.findall(sentence) if MARK.search(sentence) else []
            if marks and (" | " in line or not QUOTING.search(PLACEHOLDER.sub(" ", sentence))):
                unfilled += len(marks)
        words = WORD.findall(lowered)
        n = len(words)
        if not n:
            continue
        stated = STATED.match(lowered) if n <= STATEMENT else None
        if FILLER.match(lowered) or n >= 3 and latin(words) or n >= 5 and len(set(words)) == 1 or words[0] in MASH and all(w in MASH for w in words):
            filler += n
        elif ERROR.match(lowered) or stated and (n <= HEADING or stated["art"]):
            error += n
        elif WAITING.match(lowered) or scripts and SCRIPT_WORD.search(lowered) and SCRIPT.search(lowered):
            script += n
        elif not NAVIGATION.match(line):
            rest += n
    return unfilled, filler, error, script, rest


def signed(text: str) -> int:
    """The number that Spark's xxhash64 gives a text."""
    return int.from_bytes(xxhash.xxh64_digest(text, seed=42), "big", signed=True)


def read_text(text: str) -> tuple[int, list[tuple[int, tuple[int, int, int, int, int]]]]:
    """Hash of a text, and of each of its lines the hash of its normal form and its counts.

    In the normal form letters are lower case, white space is reduced, and words with figures are all the same.
    """
    plain = ENTITY.sub(lambda m: ENTITIES[m.group(1)], INVISIBLE.sub("", text))
    low = plain.lower()
    lone = {name for name in (m.lower() for m in FIELD_TAG.findall(plain)) if f"</{name}>" not in low}
    lines = []
    for raw in TAG.sub(lambda m: m.group(0) if m.group(0)[1:-1].lower() in lone else "\n", plain).splitlines():
        line = raw.strip()
        if not line:
            continue
        low_line = line.lower()
        counts = line_evidence(line, low_line)
        if lone:  # a field in angle brackets that is also the name of a tag
            fields = sum(m.lower() in lone for m in FIELD_TAG.findall(line))
            counts = (counts[0] + fields, *counts[1:])
        words = low_line.split()
        lines.append((signed(" ".join(["0" if DIGIT.search(w) else w for w in words] if DIGIT.search(low_line) else words)), counts))
    return signed(text), lines


def read_lines(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """key, _host, _text (hash) and _lines (struct of hash and counts) of every text that isn't null or blank."""
    kind = docs.schema[key].dataType.simpleString()
    line = pa.struct([("hash", pa.int64()), *((k, pa.int32()) for k in KINDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [read_text(t) for t in batch.column(2).to_pylist()]
            flat = [x for _, lines in read for x in lines]
            columns = [pa.array([h for h, _ in flat], pa.int64()), *(pa.array([c[k] for _, c in flat], pa.int32()) for k in range(len(KINDS)))]
            ends = [0]
            for _, lines in read:
                ends.append(ends[-1] + len(lines))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(line)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f for f, _ in read], pa.int64()), lists], names=[key, "_host", "_text", "_lines"])

    some = docs.filter(F.col(text).isNotNull()).select(key, F.coalesce(F.col(host), F.lit("")).alias("_host"), F.col(text).alias("_text"))
    counts = ", ".join(f"{k}: int" for k in KINDS)
    return some.mapInArrow(run, f"`{key}` {kind}, _host string, _text long, _lines array<struct<hash: bigint, {counts}>>").filter(F.size("_lines") > 0)


def recurrent(lines: DataFrame, least: int = RECURRENT, share: float = RECURRENT_SHARE) -> DataFrame:
    """_host and _hash of every line that at least ``least`` different texts of its host, and that share of them, hold.

    Copies of a text count once, so that its lines aren't taken for boilerplate however often it is copied.
    """
    texts = lines.groupBy("_host", "_text").agg(F.first(F.array_distinct("_lines.hash")).alias("_h"))
    # A null among the lines of each text counts the texts of the host.
    each = texts.select("_host", F.explode(F.concat("_h", F.array(F.lit(None).cast("long")))).alias("_hash"))
    counts = each.groupBy("_host", "_hash").agg(F.count("*").alias("_n")).filter((F.col("_n") >= least) | F.col("_hash").isNull())
    totals = counts.filter(F.col("_hash").isNull()).select("_host", F.col("_n").alias("_of"))
    return counts.filter(F.col("_hash").isNotNull()).join(totals, "_host").filter(F.col("_n") >= share * F.col("_of")).select("_host", "_hash")


def recurrent_lines(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """_host and _hash of the recurrent lines of every host; documents without host form one."""
    return recurrent(read_lines(docs.withColumn("_key", F.lit(0)), "_key", text, host))


def residue(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row for each document with evidence in what is left of it: key, unfilled, filler, error, script, rest (words), excluded.

    The host's recurrent lines are taken off first, those with evidence too; a text of which nothing but navigation
    is left has no content of its own, and is judged by the evidence of its recurrent lines, with no other words.  ``excluded`` holds where a value was left unfilled, where
    filler makes up 60 % of what is left, or where an error or a notice is left with at most 30 other words.  Null,
    empty and blank texts have no evidence and no row.  Repeated rows count once, and different texts of one key are
    judged together.  Documents without host form one host.  Other columns are ignored.
    """
    lines = cut(read_lines(docs, key, text, host))
    common = recurrent(lines).withColumn("_common", F.lit(True))
    shown = F.exists("_lines", lambda x: (x["unfilled"] > 0) | (x["filler"] > 0) | (x["error"] > 0) | (x["script"] > 0))
    each = lines.filter(shown).dropDuplicates([key, "_host", "_text"]).select(key, "_host", F.explode("_lines").alias("_l")).select(key, "_host", F.col("_l.hash").alias("_hash"), "_l.*").drop("hash")
    own = F.col("_common").isNull()
    sums = [F.coalesce(F.sum(F.when(own, F.col(k))), F.lit(0)).alias(f"_{k}") for k in KINDS] + [F.sum(k).alias(k) for k in KINDS]
    both = each.join(common, ["_host", "_hash"], "left").groupBy(key).agg(*sums)
    left = sum((F.col(f"_{k}") for k in KINDS), F.lit(0)) > 0
    judged = both.select(key, *[F.when(left, F.col(f"_{k}")).otherwise(F.lit(0) if k == "rest" else F.col(k)).alias(k) for k in KINDS])
    some = F.col("filler") + F.col("error") + F.col("script")
    page = (F.col("error") + F.col("script") > 0) & (F.col("rest") <= REST_WORDS)
    filled = (F.col("filler") > 0) & (F.col("filler") >= FILLER_SHARE * (some + F.col("rest")))
    return judged.filter((F.col("unfilled") > 0) | (some > 0)).withColumn("excluded", (F.col("unfilled") > 0) | page | filled)
