"""Template residue, filler, error pages and script notices instead of content.

Each page is read once into its visible lines, every line with its number of words and the evidence it carries: an
unfilled placeholder, an error message, a notice that scripts are required, or filler text. Normalised lines of every
kind are counted by host, and what recurs under several titles of a host is its boilerplate and is subtracted:
content that stands on every page says nothing about this one, and neither does evidence, such as a banner for
visitors without scripts, that stands on the host's pages of content. A page is found if it shows a placeholder, or
if the rest has evidence without content beside it.

Error messages are told by what they say, not by their wording: something of the web (a page, a server, a host, a
path) and that it fails, is forbidden or is not there, in any order and at any length, in seven languages.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webwarden.functions.skew import lookup_join
from webwarden.session import materialize

CONTENT, ERROR, SCRIPTS, FILLER, PLACEHOLDER, FRAME = range(6)

# Words by which a bracketed name is known to be a field that waits for its value.
_FIELDS = (
    r"(?:first|last|full|user|given|family|company|customer|client|brand|product|event|file|host|domain)?[ _-]?(?:name|vorname|nachname|nom|prénom|nombre|apellido|nome|cognome|sobrenome|naam)|e-?mail|phone|telefon|address|adresse|dirección|indirizzo|endereço|"
    r"city|stadt|ville|ciudad|zip|date|datum|fecha|data|time|amount|betrag|montant|importe|total|price|preis|prix|precio|order[ _-]?(?:number|no|id)?|account[ _-]?(?:number|no|id)?|number|nummer|link|url|logo|title|titel|titre|título|image|company|firma|customer|kunde|client|cliente|salutation|anrede|recipient|empfänger|sender|signature|unterschrift"
)
# The ways in which templates mark a value that is to be filled in, and what scripts print for none.
_PLACEHOLDERS = re.compile(
    "|".join(
        [
            r"\{\{[^{}\n]*[^\W\d][^{}\n]*\}\}", r"[$#@]\{[^{}\n]*[^\W\d][^{}\n]*\}", r"<%[^<>%\n]*[^\W\d][^<>%\n]*%>", r"\{%[^{}%\n]*[^\W\d][^{}%\n]*%\}", r"\{\$[^{}\s]+\}", r"\[\[[^\[\]\n]*[^\W\d][^\[\]\n]*\]\]", r"\*\|[^|*\n]+\|\*",
            r"%%\s*[^\W\d][^%\n]*%%", r"@@\s*[^\W\d][^@\n]*@@", r"__[A-Z][A-Z0-9_]*?__", r"\$[A-Z][A-Z0-9_]{2,}\$", r"#[A-Z][A-Z0-9_]{2,}#", r"(?<![\w%])%[A-Z][A-Z0-9_]{2,}%", r"(?<![\w{])\{[^\W\d][\w.\-]*(?: [\w.\-]+)?(?:[:|!][^{}\n]*)?\}(?!\})",
            r"\*{3}\s*[A-Z][A-Z0-9_ ]*\*{3}\s*(?:TBD|TODO|XXX)", r"<[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+>", r"(?i:[\[<](?:(?:insert|enter|your|add|put|ihr|ihre|votre|su|tu|il tuo|seu|uw) )*(?:" + _FIELDS + r")(?: here)?[\]>])(?!\()",
            r"\[(?:INSERT|ENTER|YOUR|ADD|PUT) [A-Z0-9_ ]+\]", r"(?<![\w%])%(?:\([^\W\d]\w*\)|\d+\$)[sdif]\b", r"(?<![\w%])%[sd](?![\w%])",
            r"\[object Object\]", r"\b(?:null null|undefined undefined)\b", r"^(?:[^\W\d_]+:? ){0,2}(?:NaN|undefined|null)[.!]?$",
        ]
    )
)
_MARKS = re.compile(r"[{}\[\]<>$%@*#]|__|\b(?:null|NaN|undefined)\b")

# Things of the web that an error message is about, in seven languages; addresses count as such too.
_THINGS = frozenset(
    "page pages site website web server service resource document file link url address host hostname request connection gateway domain account application app content database session answer response proxy browser visitor looking address upstream website's "
    "seite webseite seiten dienst anfrage verbindung adresse dokument datei konto anwendung inhalt sitzung angebot gesuchte gesuchten zugriff zugang ressource webserver "
    "serveur requête demande connexion fichier lien compte contenu cherchez recherchez recherchée demandée accès rubrique "
    "página sitio servidor servicio solicitud conexión dirección documento archivo enlace cuenta recurso aplicación buscaba busca acceso petición "
    "pagina sito servizio richiesta connessione indirizzo risorsa collegamento cercavi cercando cerchi accesso documento applicazione "
    "serviço pedido solicitação conexão ligação endereço ficheiro arquivo procura procurava acesso aplicação conta "
    "dienst verzoek verbinding adres bestand toegang zoekt opgevraagde webpagina".split()
)
# Words that say that something failed, is forbidden or absent by themselves.
_FAILS = frozenset(
    "error errors failed failure fails wrong unavailable missing gone denied forbidden refused blocked suspended unreachable unable unexpected invalid maintenance overloaded offline down crashed exception uncaught traceback fatal timeout unauthorized unauthorised rejected disabled deactivated vanished unknown "
    "fehler fehlgeschlagen verweigert gesperrt verboten untersagt wartung wartungsarbeiten ungültig unbekannt unterbrochen überlastet gescheitert schiefgelaufen schiefgegangen unerwartet unerwarteter unerwarteten "
    "introuvable indisponible absent absente refusé refusée interdit interdite échoué erreur inaccessible inattendue inattendu expiré invalide bloqué bloquée impossible suspendu "
    "fallo falló fallado denegado denegada prohibido prohibida mantenimiento inválida inválido inesperado inesperada bloqueado bloqueada suspendida suspendido rechazada rechazó caído "
    "errore negato negata vietato vietata manutenzione inesistente inatteso imprevisto irraggiungibile fallita fallito bloccato bloccata sospeso rifiutata rifiutato impossibile scaduta "
    "erro falha falhou negado negada proibido proibida manutenção indisponível inesperado inválido bloqueado bloqueada suspensa recusada recusado expirou ausente "
    "fout mislukt geweigerd verboden onderhoud ongeldig onbereikbaar geblokkeerd onverwachte storing".split()
)
# Words of denial, and what is denied: being there, being reached, opened or answered.
_DENIALS = frozenset("not no cannot cant longer nicht kein keine keinen pas plus aucun aucune ne non nessun nessuna não nenhum nenhuma sem niet geen".split())
_DENIED = frozenset(
    "find found available reachable exist exists open opened load loaded display displayed reach reached access accessed process processed complete completed connect respond responding response answer allowed permitted permission authorized authorised fulfilled resolved established view delivered shown handle handled serve served "
    "gefunden verfügbar erreichbar existiert gibt geladen aufrufen aufgerufen angezeigt berechtigt berechtigung antwortet verarbeitet bearbeitet öffnen geöffnet mehr vorhanden hergestellt erlaubt zugreifen antwort "
    "trouvé trouvée trouver existe disponible accessible joindre joignable droit permission autorisé autorisée ouvrir afficher affichée répond traiter traitée aboutir atteindre charger "
    "encontrado encontrada encontrar encontramos encontró permiso autorizado autorizada abrir mostrar cargar cargarse procesar responde puede accesible mostrarse "
    "trovato trovata trovare disponibile esiste autorizzato autorizzata permesso aprire mostrare caricare risponde elaborare raggiungibile raggiungere visualizzare accedere "
    "encontrado encontrada encontrar disponível existe permissão autorizado abrir mostrar carregar processar responde possível alcançar exibir aceder acessar "
    "gevonden beschikbaar bestaat bereikbaar openen geladen toestemming weergegeven reageert verwerkt geopend bereiken toegestaan".split()
)
_TOO = re.compile(r"\b(?:time-out|timed out|too (?:long|many|busy)|zu (?:lange|viele)|trop (?:de|long|longtemps)|demasiad[oa]s?|troppe|troppi|troppo tempo|muitas?|muitos|te (?:lang|veel))\b")
_AGAIN = re.compile(r"\b(?:try again|retry|come back later|check back|reload|refresh|versuchen sie|später (?:noch einmal|erneut|wieder)|neu laden|réessaye[rz]|rechargez|int[eé]nt[ea](?:lo|r)?|vuelva|riprov[ai]\w*|ricarica|torna più|tente novamente|tentar|volte mais|recarregue|probeer|herlaad)\b")
_WHEN = frozenset("second seconds minute minutes hour hours moment later again soon sekunden minuten stunden augenblick später erneut nochmal wieder secondes moment tard heures instants instant nouveau segundos minutos horas momento tarde nuevo secondi minuti istanti tardi ore nuovo breve momentos novamente instantes novo seconden ogenblik opnieuw straks".split())
# Words that begin advice for the case that something fails, which is no message that it did.
_WHETHER = frozenset("if when whenever whether should wenn falls sobald ob si quand lorsque cuando se quando qualora als wanneer indien".split())
# Cries that error pages begin with, and words that headings of failure may have besides.
_CRIES = frozenset("oops whoops ups hoppla oups aïe vaya ops oeps uups".split())
_GLUE = frozenset(
    "the a an this that is was are were be been has have had there we you your our it to of on in at for from by and or went something sorry internal bad temporarily temporary requested the too many requests request time out http https status code access permission closed establishing reached t be can could currently found entity large method type "
    "die der das den dem ein eine einer ist sind war wurde auf im in zu von leider interner interne internal server angeforderte etwas unter dieser diese sie haben hat konnte wurden vorübergehend derzeit "
    "le la les l un une est sont d de du des en à sur ce cette interne désolé momentanément temporairement être a été quelque chose s vous avons "
    "el los las una uno es está ha en de del al se lo este esta interno algo salió mal siento temporalmente "
    "il lo gli i uno è stato stata si sul di qualcosa è andato storto interno spiacenti temporaneamente "
    "o os as um uma é foi está no na do da ocorreu algo deu errado interno desculpe temporariamente "
    "het een is er op van de iets ging mis helaas tijdelijk interne".split()
)
_STATUS = frozenset("400 401 402 403 404 405 406 407 408 409 410 411 412 413 414 415 416 417 418 421 422 423 424 425 426 428 429 431 451 500 501 502 503 504 505 506 507 508 510 511 520 521 522 523 524 525 526 527 530".split())
_NAMES_STATUS = frozenset("error errors http https status code fehler erreur errore erro fout código codice fehlercode statuscode".split())
_TRACE = re.compile(r"\b[A-Z]\w+(?:Error|Exception)\b|(?i:\bstack ?trace\b|\btraceback \(most recent call last\)|\bon line \d+|\bat line \d+|#0 \S+\(|\b(?:incident|ray|correlation|trace|error)(?: id| no| number)?[:#]? ?[0-9a-f-]*\d)")
# Words for scripts.
_SCRIPT_WORDS = frozenset("javascript javascripts js script scripts scripting skript skripte skripten ecmascript".split())
#: Words without one of which a line is no message; the parts of _TOO and _AGAIN among them.
_SIGNS = _FAILS | _DENIALS | _SCRIPT_WORDS | _CRIES | _STATUS | frozenset("too zu trop demasiado demasiada demasiados demasiadas troppe troppi troppo muita muitas muito muitos te timed time out try retry come check reload refresh versuchen später neu réessayez réessayer rechargez inténtelo intente intentar vuelva riprova riprovare riprovate ricarica torna tente tentar volte recarregue probeer herlaad trace traceback line incident ray correlation".split())
#: Hosts, paths, addresses and files in a sentence, which are things of the web too; in lower case.
_ADDRESS = re.compile(r"(?<!\S)/[\w.%-]+(?:/[\w.%-]*)*|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}\b|\b\d{1,3}(?:\.\d{1,3}){3}\b|https?://\S*")

# Words for needing, allowing or lacking scripts.
_SCRIPT_NEEDS = frozenset(
    "enable enabled activate activated allow allowed need needs needed require requires required must disabled off blocked without unsupported turn turned switch switched permit "
    "aktivieren aktiviert aktiviere einschalten eingeschaltet erlauben erlaubt zulassen benötigt benötigen erforderlich braucht brauchen ohne deaktiviert ausgeschaltet müssen muss voraussetzung "
    "activez activer activé activée autorisez autoriser nécessite nécessaire besoin requis requiert sans désactivé désactivée faut exige "
    "active activar activado habilite habilitar habilitado permita permitir requiere requieren requerido necesita necesitan necesario sin desactivado deshabilitado debe "
    "attiva attivare attivato abilita abilitare abilitato consenti richiede richiedono richiesto necessario necessita senza disattivato disabilitato bisogno occorre "
    "ative ativar ativado habilitado permita requer requerem exige precisa necessário necessita sem desativado desabilitado "
    "inschakelen schakel ingeschakeld activeer toestaan vereist nodig zonder uitgeschakeld moet".split()
)
_WORKS = re.compile(r"\b(?:works?|funktioniert|fonctionne|funciona|funziona|werkt) (?:best|only|better|properly|nur|besser|am besten|mieux|uniquement|mejor|solo|sólo|meglio|melhor|só|apenas|alleen|het best)\b|\bthis (?:page|site|app|application) uses\b")
# Words that filler text is made of.
_FILLER_WORDS = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo "
    "consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "text paragraph dummy copy sample example your heading headline here goes content placeholder insert add replace this with own title subtitle caption filler tbd todo tba "
    "hier steht platzhalter inhalt überschrift ihr ihren ihre mustertext blindtext fülltext beispiel beispieltext später absatz einfügen eingeben ersetzen text titel "
    "exemple texte contenu remplacer remplacez factice paragraphe votre titre ici provisoire insérer insérez ajoutez saisissez "
    "aquí su contenido provisional texto título ejemplo relleno párrafo reemplazar borrador inserte escriba introduzca muestra "
    "testo esempio qui tuo segnaposto inserisci inserire titolo paragrafo contenuto fittizio aqui seu conteúdo exemplo insira parágrafo preenchimento substitua tekst voorbeeld plaats uw inhoud voorbeeldtekst invoegen "
    "asdf qwer qwerty jkl test testtest testing foo bar baz qux blah aaaa xxx xxxx".split()
)
#: Filler's own words: without one of them a line of small words is not filler.
_FILLER_SIGNS = _FILLER_WORDS - frozenset("do in ad ex ea eu non id est et ut sit sed qui your here this with own title add in hier ihr ihren ihre steht später titel votre titre ici aquí su título qui tuo titolo aqui seu uw text content inhalt contenu contenido texte texto testo tekst conteúdo contenuto inhoud".split())
#: The part of a line's words that must be filler, and the least number of words.
FILLER_PART, FILLER_LEAST = 0.8, 2
#: Small words alone are filler if a line has this many and nothing else.
FILLER_WHOLE = 4
#: Words of content up to which a page with evidence counts as having none: of any kind, or under an error heading;
#: and the part of the filler's words that content may have in a page of filler.
SPARE_WORDS, HEADED_WORDS, FILLED_PART = 6, 24, 0.5
#: A line is boilerplate of a host if it stands under this many different titles of it.
RECURS_UNDER = 3
#: and under this share of all its titles, so that chance repeats on a host of many pages are none.
RECURS_SHARE = 0.2

_COMMENT = re.compile(r"(?s)<!--.*?-->")
_HIDDEN = re.compile(r"(?is)<(script|style|pre|code|template|svg)\b[^>]*>.*?</\1\s*>")
_INLINE = re.compile(r"(?i)</?(?:b|i|em|strong|a|u|s|small|wbr|mark|font|abbr|sub|sup|big|tt|bdi|bdo|cite|q|label)(?:\s[^>]*)?/?>")
_BUTTON = re.compile(r"(?is)<(?:title|button|option|select|nav|footer)\b[^>]*>.*?</(?:title|button|option|select|nav|footer)\s*>")
#: A tag begins with a letter, a slash, "!" or "?": "<%" and "< 5" are text, as in a browser.
_TAG = re.compile(r"<[A-Za-z/!?][^>]*>")
_SHY = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_WORD = re.compile(r"[^\W_]+(?:['’.\-@/][^\W_]+)*")
_PLAIN = re.compile(r"[^\W_]+")
_ELIDED = re.compile(r"(?<=n)['’]t\b|(?<![^\W_])n['’]")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+(?=[^\W\d_])")


def _clean(text: str) -> str:
    return " ".join(_SHY.sub("", html.unescape(text)).split())


def _tokens(low: str) -> list[str]:
    if "'" in low or "’" in low:
        low = _ELIDED.sub(" not ", low)
    return _PLAIN.findall(low)


def _is_heading(words: list[str], fails: bool) -> bool:
    """Whether a line is nothing but a status, a cry or a failure: "404", "HTTP 503 Service Unavailable", "Whoops",
    "Access denied"."""
    at = 0
    while at < len(words) and words[at] in _NAMES_STATUS:
        at += 1
    rest = words[at + 1 :]
    if at < len(words) and words[at] in _STATUS and (not rest or all(w in _GLUE or w in _THINGS or w in _FAILS or w in _DENIALS or w in _DENIED for w in rest)):
        return True
    if words[0] in _CRIES and len(words) == 1:
        return True
    return fails and all(w in _FAILS or w in _DENIALS or w in _DENIED or w in _THINGS or w in _GLUE or w in _CRIES for w in words)


def kind_of(text: str) -> tuple[int, bool]:
    """(kind, heading): the evidence that one sentence or line of any length carries, and whether it is the heading of
    an error page."""
    if _MARKS.search(text) and _PLACEHOLDERS.search(text):
        return PLACEHOLDER, False
    low = text.lower()
    words = _tokens(low)
    if not words:
        return CONTENT, False
    if len(words) >= FILLER_LEAST:
        filler = sum(map(_FILLER_WORDS.__contains__, words))
        if filler >= FILLER_PART * len(words) and (not _FILLER_SIGNS.isdisjoint(words) or filler == len(words) >= FILLER_WHOLE):
            return FILLER, False
    own = set(words)
    if own.isdisjoint(_SIGNS) and not ("rror" in text or "xception" in text):
        return CONTENT, False
    # The names in an address say nothing: "x.invalid" is not an invalid x.
    bare = _ADDRESS.sub(" ", low)
    if bare != low:
        words = _tokens(bare) or words
        own = set(words)
    if not own.isdisjoint(_SCRIPT_WORDS) and (not own.isdisjoint(_SCRIPT_NEEDS) or _WORKS.search(low)):
        return SCRIPTS, False
    fails = not own.isdisjoint(_FAILS) or (not own.isdisjoint(_DENIALS) and not own.isdisjoint(_DENIED)) or _TOO.search(low) is not None or _TRACE.search(text) is not None
    if _is_heading(words, fails):
        return ERROR, True
    if fails and (not own.isdisjoint(_THINGS) or words[0] in _CRIES or len(bare) != len(low)) and words[0] not in _WHETHER:
        return ERROR, False
    if _AGAIN.search(low) and not own.isdisjoint(_WHEN):
        return ERROR, False
    return CONTENT, False


def page_lines(dom: str) -> tuple[str, list[tuple[str, int, int, bool]]]:
    """(title, [(line, words, kind, heading)]) of what a page shows, noscript included. Titles, buttons and menus count
    as frame unless they carry evidence; a paragraph is cut into sentences, so that an error message that is mentioned
    beside content does not make the content evidence."""
    # Nothing opened after the last ">" can be a tag, nor after the last "-->" a comment; trying would be slow.
    end, last = dom.rfind("-->") + 3, dom.rfind(">") + 1
    head = _COMMENT.sub("", dom[:end]) + dom[end:last] if end > 2 else dom[:last]
    tail = dom[last:]
    body = _HIDDEN.sub("\n", head)
    frames = [_clean(_TAG.sub(" ", m.group(0))) for m in _BUTTON.finditer(body)]
    title = frames[0] if frames and body[: body.find("</title")].lower().find("<title") >= 0 else ""
    body = _TAG.sub("\n", _INLINE.sub("", _BUTTON.sub("\n", body).replace("\r", " "))) + "\n" + tail
    out = []
    for t in frames:
        if t:
            k, heading = kind_of(t)
            out.append((t, len(_WORD.findall(t)), k if k != CONTENT else FRAME, heading))
    for line in filter(None, map(_clean, body.split("\n"))):
        before = CONTENT
        for t in _SENTENCE.split(line):
            kind, heading = kind_of(t)
            if kind == CONTENT and before == SCRIPTS and not _SCRIPT_NEEDS.isdisjoint(_tokens(t.lower())):
                kind = SCRIPTS  # "JS is off. Switch it on, then reload."
            out.append((t, len(_WORD.findall(t)), kind, heading))
            before = kind
    return title, out


_DIGITS = re.compile(r"\d+")
_COUNTED = ("placeholders", "heads", "error_words", "script_words", "filler_words", "content_words")
_SCHEMA = pa.schema(
    [("row_id", pa.int64()), ("host", pa.string()), ("title", pa.int64()), *[(c, pa.int32()) for c in _COUNTED], ("lines", pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int32()), ("kind", pa.int32()), ("head", pa.int32())])))]
)
_DDL = "row_id bigint, host string, title bigint, " + "".join(f"{c} int, " for c in _COUNTED) + "lines array<struct<line:bigint,words:int,kind:int,head:int>>"


def _digest(text: str) -> int:
    raw = _DIGITS.sub("0", text.lower()).encode("utf-8", "replace")
    return zlib.crc32(raw) << 31 | zlib.crc32(raw[::-1]) >> 1


def measured_page(dom: str) -> tuple:
    """(title, placeholders, error headings, error, script, filler and content words, lines) of one page. lines has
    each line of content or evidence with its digest, words, kind and whether it is an error heading."""
    title, lines = page_lines(dom)
    words = [0] * 6
    heads = placeholders = 0
    kept = []
    for text, n, kind, heading in lines:
        n = max(1, n) if kind != CONTENT or n else 0
        words[kind] += n
        placeholders += kind == PLACEHOLDER
        heads += heading
        if kind < PLACEHOLDER and n:
            kept.append((_digest(text), n, kind, int(heading)))
    return _digest(title), placeholders, heads, words[ERROR], words[SCRIPTS], words[FILLER], words[CONTENT], kept


def page_measures(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """What each page shows, as numbers and the digests of its lines; null and empty pages give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hosts, pages = (b.column(i).to_pylist() for i in range(3))
            rows = [(i, h, *measured_page(t)) for i, h, t in zip(ids, hosts, pages)]
            cols = list(zip(*rows)) if rows else [()] * len(_SCHEMA)
            arrays = [pa.array([[dict(zip(("line", "words", "kind", "head"), x)) for x in v] for v in c] if f.name == "lines" else c, f.type) for c, f in zip(cols, _SCHEMA)]
            yield pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)

    host = F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url_col}`"), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]+)", 1)), F.lit(""))
    source = df.select(F.col(f"`{id_col}`").cast("bigint").alias("row_id"), host.alias("host"), F.col(f"`{html_col}`").alias("dom")).filter(F.length("dom") > 0)
    return source.mapInArrow(run, _DDL)


def recurrent_lines(pages: DataFrame) -> DataFrame:
    """(line_key, uses): the boilerplate of each host. A line of content recurs if it stands under RECURS_UNDER titles
    and RECURS_SHARE of all titles of its host. A line of evidence recurs if it does so on pages that have content of
    their own: a host of error pages has no boilerplate of errors, but a banner on every article is one.

    Only hosts with enough titles are counted. A host that holds a large part of all pages is sent by broadcast in the
    join, and its lines are counted in two steps, by title first.
    """
    titled = pages.groupBy("host", "title").count().groupBy("host").agg(F.count(F.lit(1)).alias("host_titles"), F.sum("count").alias("pages")).filter(F.col("host_titles") >= RECURS_UNDER)
    busy = lookup_join(pages.select("host", "title", "content_words", "lines"), materialize(titled, "titled"), "host", "pages")
    full = F.col("content_words") > SPARE_WORDS
    counts = F.filter("lines", lambda x: (x["kind"] == CONTENT) | full)
    under = busy.select("host", "title", "host_titles", F.explode(F.array_distinct(F.transform(counts, lambda x: x["line"]))).alias("line"))
    by_title = under.groupBy(F.xxhash64("host", "line").alias("line_key"), "title", "host_titles").agg(F.count(F.lit(1)).alias("n"))
    counted = by_title.groupBy("line_key").agg(F.count(F.lit(1)).alias("titles"), F.sum("n").alias("uses"), F.max("host_titles").alias("host_titles"))
    return counted.filter((F.col("titles") >= RECURS_UNDER) & (F.col("titles") >= RECURS_SHARE * F.col("host_titles"))).select("line_key", "uses")


def residual_pages(df: DataFrame, id_col: str = "capture_id", url_col: str = "url", html_col: str = "dom_html", subtract: bool = True) -> DataFrame:
    """(row_id, placeholders, error_words, script_words, filler_words, residual_words, is_residue) of every page that
    is not null or empty; the words are those left once boilerplate is subtracted.

    A page that has evidence and no content, all of it boilerplate, keeps its evidence: nothing else is on it.
    Repeated rows are judged each; an empty table gives an empty result. `subtract` is for tests: without it the
    method's subtraction is left out.
    """
    pages = materialize(page_measures(df, id_col, url_col, html_col), "pages")
    parts = ["heads", "error_words", "script_words", "filler_words", "content_words"]
    evidence = F.col("error_words") + F.col("script_words") + F.col("filler_words")
    judged = pages.filter(evidence > 0)
    if subtract:
        lines = judged.select("row_id", "host", F.explode("lines").alias("l")).select("row_id", F.xxhash64("host", "l.line").alias("line_key"), "l.words", "l.kind", "l.head")
        of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("words")).otherwise(0))
        usual = lookup_join(lines, materialize(recurrent_lines(pages), "recurrent"), "line_key", "uses").groupBy("row_id")
        usual = usual.agg(F.sum("head").alias("u_heads"), *[of(k).alias(f"u_{p}") for k, p in ((ERROR, "error_words"), (SCRIPTS, "script_words"), (FILLER, "filler_words"), (CONTENT, "content_words"))])
        joined = judged.join(usual, "row_id", "left")
        left = {p: F.greatest(F.lit(0), F.col(p) - F.coalesce(f"u_{p}", F.lit(0))) for p in parts}
        nothing = (sum((left[p] for p in parts[1:]), F.lit(0)) == 0) & (F.col("content_words") <= SPARE_WORDS)
        judged = joined.select("row_id", "placeholders", *[F.when(nothing & (p != "content_words"), F.col(p)).otherwise(left[p]).cast("int").alias(p) for p in parts])
    both = judged.select("row_id", "placeholders", *parts).unionByName(pages.filter(evidence == 0).select("row_id", "placeholders", *parts)).withColumnRenamed("content_words", "residual_words")
    residual = F.col("residual_words")
    bare = (evidence > 0) & (residual <= SPARE_WORDS)
    headed = (F.col("heads") > 0) & (residual <= HEADED_WORDS)
    filled = (residual <= FILLED_PART * F.col("filler_words")) & (F.col("filler_words") > 0)
    return both.withColumn("is_residue", (F.col("placeholders") > 0) | bare | headed | filled).drop("heads")


# What names of interstitial kinds end in, before a version or a remark in brackets.
_KIND_NAME = re.compile(
    r"(?i)^\s*(?!\d{3}\b)(?:[^\W_]+[ \-]+){0,5}(?:wall|gate|barrier|probe|loader|cloak|shim|decoy|challenge|check|captcha|interstitial|filter|trap|shield|splash|redirect|screen|fence|room|queue|lobby|notice|prompt|banner|overlay|popup|modal|page|gateway|timer|countdown|consent|login|form|warning|lock|throttle|mirror)s?"
    r"(?:\s*\([^)]*\))?(?:\s*v?\d+(?:\.\d+)*)?\s*$"
)


def residual_type(value: str) -> bool:
    """Whether an interstitial type is residue and not the name of a kind: it carries evidence, or it is a sentence."""
    text = _clean(value)
    kinds = [kind_of(t)[0] for t in (text, *_SENTENCE.split(text))]
    if PLACEHOLDER in kinds:
        return True
    if not text or _KIND_NAME.match(text):
        return False
    return any(k != CONTENT for k in kinds) or text.endswith((".", "!", "?"))


def residual_types(df: DataFrame, id_col: str = "result_id", type_col: str = "interstitial_type") -> DataFrame:
    """(row_id) of the rows whose type is residue. The distinct values are judged once and joined back; null and
    blank values are no cases."""
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("row_id"), F.col(f"`{type_col}`").alias("value")).filter(F.col("value").rlike(r"\S"))
    distinct = rows.groupBy("value").agg(F.count(F.lit(1)).alias("uses"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [residual_type(v) for v in b.column(0).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return lookup_join(rows, materialize(distinct.mapInArrow(run, "value string, uses bigint"), "types"), "value", "uses").select("row_id")
