"""Trusted beginnings of segments: what error pages, block pages, notices about scripts and filler say, by what they are about and
not by their wording: a subject and what is said of it, in English, German, French and Spanish. A segment is masked text
(``residue_text``): lower case, no marks, ``0`` for a number, ``js`` for any word for scripts, ``§`` for a name.

A label by itself makes no residue: all that a document says must be labelled.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc

_JS = r"(?:js|cookies?)"
_W = r"(?:\S+ )"
_THING = r"(?:page|site|website|file|document|url|address|resource|content|item|article|record|view|link|image|video|entry|screen|section)"
_PLACE = r"(?:page|site|website|service|server|system|application|app|platform|portal|console|dashboard|viewer|database|backend|gateway|upstream(?: server)?|host|proxy)"
_ON = r"(?:enable|re-enable|activate|allow|permit|unblock|turn on|switch on)"
_STATUS = (
    r"(?:page |file |site )?not found|bad (?:gateway|request)|(?:service|server|site|page) (?:temporarily |currently )?unavailable|gateway time ?-?out|forbidden|unauthori[sz]ed|payment required|method not allowed|"
    r"not acceptable|request time ?-?out|gone|conflict|too many requests|internal (?:server )?error|not implemented|"
    r"(?:seite |datei )?nicht gefunden|nicht verfügbar|dienst nicht verfügbar|verboten|(?:page |fichier )?(?:introuvable|non trouvée?)|interdit|service indisponible|"
    r"(?:página |archivo )?no encontrad[ao]|prohibido|servicio no disponible"
)

#: Each must match from a segment's beginning; ``$`` where the whole segment is meant.
NOTICES = (
    # scripts, English
    rf"(?:please |kindly |sorry |you (?:must|need to|have to|should|may need to) )*{_ON} {_W}{{0,3}}{_JS}\b",
    rf"(?:please |you (?:must|need to|have to|should) )*(?:turn|switch) {_W}{{0,3}}{_JS} (?:back )?on\b",
    rf"(?:it (?:looks|seems|appears) (?:like|that|as if) )?(?:your )?{_JS} (?:and js |and cookies |support )?(?:is|are|has been|have been|must be|needs to be|seems to be|appears to be) {_W}{{0,2}}(?:turned|disabled|switched|off|blocked|required|needed|necessary|enabled|allowed|permitted|available|supported|unavailable|inactive|deactivated|missing)\b",
    rf"(?:no |please )?{_JS} (?:required|disabled|needed|blocked|unavailable|not (?:enabled|available|supported|detected))\b",
    rf"(?:sorry )?(?:this|the|our|that) {_W}{{1,5}}(?:needs?|requires?|relies on|depends on|cannot (?:run|work|load) without) {_W}{{0,2}}{_JS}\b",
    rf"(?:sorry )?you(?:'ll| will)? (?:need|require) {_W}{{0,4}}{_JS}\b",
    rf"(?:to|in order to) {_W}{{1,10}}(?:{_ON}|you (?:must|need)) {_W}{{0,4}}{_JS}\b",
    rf"(?:it (?:looks|seems) (?:like|that) )?your browser (?:does not|doesn't|has|is|seems|appears|did not|cannot|can't|blocks?) {_W}{{0,6}}{_JS}\b",
    rf"(?:we're sorry |we are sorry |sorry |but )*{_W}{{1,6}}(?:doesn't|does not|won't|will not|can't|cannot|can not|only) (?:work|run|load|function|start|display|be (?:shown|displayed|loaded)) {_W}{{0,5}}(?:without|with) {_W}{{0,2}}{_JS}\b",
    rf"without {_W}{{0,2}}{_JS} {_W}{{0,5}}(?:can't|cannot|can|won't|will|does|doesn't|is|are|not)\b",
    rf"(?:for|in order for) {_W}{{1,12}}{_ON} {_W}{{0,3}}{_JS}\b",
    # scripts, the other languages
    rf"(?:bitte|sie müssen|sie sollten|hierfür|dazu) {_W}{{0,2}}{_JS} {_W}{{0,4}}(?:aktivieren|einschalten|erlauben|zulassen|anschalten)\b",
    rf"(?:bitte |sie müssen )*(?:aktivieren|schalten|erlauben|gestatten) (?:sie )?{_W}{{0,3}}{_JS}\b",
    rf"(?:um|für) {_W}{{1,10}}{_JS} {_W}{{0,4}}(?:aktiv\w+|ein|erlaub\w+|benötigt|erforderlich|nötig|notwendig)\b",
    rf"{_JS} (?:ist|sind|wurde|muss|wird) {_W}{{0,5}}(?:ausgeschaltet|abgeschaltet|deaktiviert|blockiert|gesperrt|erforderlich|nötig|notwendig|benötigt|aktiviert\w*|eingeschaltet|inaktiv)\b",
    rf"(?:diese|dieser|dieses|die|der|das|sie|ihr browser) {_W}{{0,3}}(?:benötigt|benötigen|braucht|brauchen|erfordert|verlangt|setzt|unterstützt|funktioniert|läuft) {_W}{{0,3}}{_JS}\b",
    rf"(?:sans|sin|ohne) {_W}{{0,2}}{_JS} {_W}{{0,3}}(?:la|le|les|l'\S+|cette|ce|no|el|los|esta|este|kann|können|ist|wird|funktioniert|geht|läuft|der|die|das|diese|dieser|vous|usted)\b",
    rf"(?:veuillez|merci d'|pensez à|vous devez|il faut)? ?(?:activer|activez|autoriser|autorisez|réactiver) {_W}{{0,3}}{_JS}\b",
    rf"(?:pour|para) {_W}{{1,10}}(?:activez|activer|autorisez|autoriser|active|activar|permita|habilite|habilitar) {_W}{{0,3}}{_JS}\b",
    rf"{_JS} (?:est|sont|doit|semble|n'est|está|debe|es|no está|parece) {_W}{{0,4}}(?:désactivés?|bloqués?|requis|nécessaires?|activés?|desactivado|deshabilitado|bloqueado|necesario|requerido|obligatorio|activado|habilitado|activo)\b",
    rf"(?:cette|ce|cet|l'\S+|le|la|vous|votre navigateur) {_W}{{0,3}}(?:nécessite|requiert|exige|besoin|avez besoin|ne prend|ne supporte|ne fonctionne) {_W}{{0,4}}{_JS}\b",
    rf"(?:por favor )?(?:active|activa|habilite|habilita|permita|debe (?:activar|habilitar)) {_W}{{0,3}}{_JS}\b",
    rf"(?:esta|este|la|el|su navegador|necesita|se) {_W}{{0,3}}(?:necesita|requiere|precisa|exige|no admite|no soporta|usa) {_W}{{0,3}}{_JS}\b",
    # status lines
    rf"(?:(?:http|https|status|error|erreur|fehler|code|codigo|código|statut) )*0 (?:error |erreur |fehler )?(?:{_STATUS})\b",
    rf"(?:error |oops |sorry )?(?:{_STATUS})$",
    r"(?:http (?:status|error|code)|status code|error|erreur|fehler|http)(?: code)? 0$",
    # something is not there
    rf"(?:we're sorry |we are sorry |sorry |oops )*(?:the|this|that|your|no such|requested) {_W}{{0,2}}{_THING} (?:(?:that )?(?:you|we|which) {_W}{{1,6}}|at this {_W}|you're {_W}{{1,2}})?(?:was|is|has|have|had|does|doesn't|did|didn't|could|couldn't|can|can't|cannot|isn't|wasn't|may|might|no longer|seems?) ?{_W}{{0,3}}(?:not|exists?|found|moved|removed|deleted|available|unavailable|gone|expired|archived|renamed|display\w*|shown|loaded|accessible)\b",
    rf"(?:sorry |oops )?(?:the|this) {_THING} (?:that )?(?:you|you're|you are|you have|you've) (?:just )?(?:asked|request\w*|look\w*|tr\w+|search\w*|want\w*|follow\w*|click\w*|seek\w*|enter\w*|typed)\b",
    rf"(?:page|site|file|document) (?:not found|missing|unavailable|expired|removed)\b|no such (?:revision|page|file|document|resource|record|address)\b",
    r"(?:we're sorry |we are sorry |sorry |oops |but |unfortunately )*we (?:could not|couldn't|cannot|can't|can not|were unable to|are unable to|did not|didn't) (?:find|locate|connect|reach|load|process|complete|display|show|open|verify|serve|get) ",
    rf"(?:diese|die|der|das|dieser|dieses) (?:von ihnen )?(?:angeforderte|gesuchte|gewünschte|aufgerufene)?n? ?(?:seite|datei|dokument|inhalt|adresse|link|verweis) {_W}{{0,6}}(?:nicht|existiert|verschoben|entfernt|gelöscht|abgelaufen|verfügbar|ungültig)\b",
    r"(?:seite|datei|dokument|inhalt) (?:nicht|wurde nicht|existiert nicht|konnte nicht) ",
    rf"(?:la|le|cette|ce|l') ?(?:page|fichier|document|contenu|lien|adresse|site) {_W}{{0,7}}(?:n'existe|introuvable|n'est|déplacée?|supprimée?|expiré|disponible|indisponible)\b|page (?:introuvable|non trouvée|inexistante)\b",
    rf"(?:la|el|esta|este) (?:página|archivo|documento|contenido|enlace|dirección|sitio) {_W}{{0,7}}(?:no|existe|movido|eliminad[oa]|caducado|disponible|encontrad[ao]|encontró)\b|página (?:no encontrada|inexistente)\b",
    # failures
    r"(?:oops|whoops|ooops|uh-oh|uh oh|ups|hoppla|oups|vaya)$|(?:oops |whoops |sorry |oh no )*(?:something|things) (?:went|has gone|have gone|is|broke) (?:terribly |badly |horribly )?(?:wrong|broken)?",
    r"(?:oops |sorry |there (?:was|has been) )*(?:an? )?(?:unexpected|unknown|internal|unhandled|fatal|critical|application|runtime) (?:server |system |application )?(?:error|exception|problem)(?: has| was)?(?: occurred| happened| encountered|$)",
    r"(?:oops |sorry )*(?:an?|there was an?) (?:\S+ )?(?:error|problem|exception) (?:has )?(?:occurred|happened|while|processing|loading|on our)\b|(?:internal (?:server )?|fatal |server |system )error$",
    r"(?:cannot|can't|could not|couldn't|unable to|failed to) (?:render|display|load|connect to|reach|establish|open the|show|process your|find the) ",
    rf"(?:the|our) (?:web |remote |origin )?{_PLACE} (?:received|returned|got|did not|didn't|is|was|could not|couldn't|cannot|can't|has|took|encountered|sent|does not|doesn't|isn't) {_W}{{0,5}}(?:answer|response|respond\w*|reach\w*|connect\w*|unavailable|available|overloaded|busy|offline|down|error|complete|process|fulfil\w*|long|problem|closed|maintenance)\b",
    r"interner (?:server ?fehler|fehler)\b|serverfehler$|(?:es ist |leider ist |ein )*(?:ein )?(?:unerwarteter|unbekannter|interner|schwerer|technischer) fehler\b|(?:da ist |es ist |leider ist )?etwas (?:ist )?schief\w*",
    r"erreur (?:interne|inattendue|inconnue|du serveur|fatale)\b|(?:une|désolé une) erreur (?:interne |inattendue |inconnue |technique )?(?:est survenue|s'est produite|est apparue)?",
    r"error (?:interno|inesperado|desconocido|del servidor|fatal)\b|(?:se ha producido|se produjo|ha ocurrido|ocurrió|hubo|lo sentimos) {0}un (?:error|problema)\b|algo (?:salió|ha salido|fue) mal\b".replace("{0}", ""),
    r"quelque chose (?:s'est|a) mal\b",
    rf"(?:the|your|this) (?:network |database |server )?connection (?:has |was |is |to {_W}{{1,4}})*(?:timed|lost|reset|closed|refused|failed|interrupted|could)\b|this {_THING} (?:isn't|is not) (?:working|available|here)\b",
    rf"(?:der|dieser|unser) (?:server|dienst|webserver) {_W}{{0,4}}(?:erreichbar|antwortet|überlastet|verfügbar|geantwortet)\b|(?:le|ce|notre) (?:serveur|service) (?:ne|n'a|est) {_W}{{0,3}}(?:répond|répondu|pas|surchargé|indisponible)\b|service (?:temporairement |momentanément )?indisponible\b|(?:el|este|nuestro) servidor {_W}{{0,3}}(?:responde|respondió|sobrecargado|disponible)\b|servicio (?:temporalmente )?no disponible\b",
    # access, sessions, load
    rf"(?:(?:error|sorry) )?(?:access|permission|entry)(?: to {_W}{{1,4}})? ?(?:is |was |has been )?(?:denied|forbidden|restricted|blocked|refused)\b",
    rf"(?:sorry )?you (?:do not|don't|are not|aren't|have not been|lack|have no|have been|are) {_W}{{0,3}}(?:permissions?|authori[sz]ed|allowed|permitted|access|rights?|blocked|banned|granted|entitled)\b",
    rf"(?:your|the|this) (?:request|access|ip|ip address|connection|account) (?:was|is|has been|could not be|cannot be) {_W}{{0,2}}(?:blocked|rejected|denied|limited|refused|flagged|suspended|completed|processed|forbidden)\b|request (?:was )?(?:blocked|rejected|denied|refused)\b",
    rf"(?:your|this|the) {_W}{{0,2}}(?:session|link|login|token|invitation|invite|link you followed|link you used) (?:has|is|was|have) {_W}{{0,2}}(?:expired|ended|timed|closed|invalid|valid|broken|longer)\b|session (?:expired|timed out|ended)\b",
    r"(?:please |you (?:must|need to|have to) |you must be |you need to be )+(?:log|sign|logged|signed)(?: |-)?in\b|(?:log|sign)(?: |-)?(?:in|on) (?:again|required|is required|to (?:continue|view|go|see|access|proceed))\b|login (?:is )?(?:required|needed)\b|(?:authentication|authori[sz]ation) (?:is )?(?:required|failed|needed)\b",
    r"too many (?:requests|attempts|connections|redirects)\b|rate limit (?:exceeded|reached)\b|(?:please )?slow down$",
    r"(?:please )?(?:try|retry|come back|check back|visit us|refresh|reload|wait)(?: (?:this|the))?(?: page)? (?:again )?(?:later|shortly|soon|in (?:a|0)|after|0 (?:seconds?|minutes?|hours?)|a (?:moment|minute|few)|(?:and|to) try)\b",
    r"(?:please wait |while |we are |we're |we |just a moment )*(?:checking|check|verify|validate|verifying|validating) (?:that |if |whether )?(?:your|the|you) (?:\S+ )?(?:browser|connection|secure|human|identity|are|site)\b|(?:please )?(?:verify|confirm|prove) (?:that )?you(?:'re| are) (?:a |not a )?(?:human|person|robot|bot)\b|are you (?:a )?(?:human|robot)\b|(?:please )?(?:complete|solve) the captcha\b|(?:ddos|bot) protection\b|just a moment$|one moment please\b",
    rf"(?:(?:sorry|oops) )?(?:this|the|our) (?:\S+ )?{_PLACE} (?:is|has been|will be|went) {_W}{{0,3}}(?:down|closed|unavailable|offline|maintenance|maintained|construction|updated|upgraded|suspended|disabled)\b",
    rf"(?:sorry )?we(?:'re| are) {_W}{{0,2}}(?:down|closed|offline|performing|undergoing|updating|upgrading|doing|carrying|working on|experiencing|having)\b|(?:we'll be|we will be|be) (?:right )?back\b|(?:scheduled|planned|ongoing|routine|emergency|site|system) maintenance\b|(?:under|down for|closed for|undergoing) {_W}{{0,2}}(?:maintenance|construction)\b|maintenance (?:mode|in progress|work)\b",
    rf"(?:zugriff|zugang) {_W}{{0,2}}(?:verweigert|gesperrt|verboten|untersagt|abgelehnt)\b|(?:sie haben|ihnen fehlt|ihnen fehlen|sie sind) {_W}{{0,4}}(?:berechtigung(?:en)?|rechte|zugriff|berechtigt|befugt|erlaubt|angemeldet)\b|(?:ihre|die|diese|ihr) (?:anfrage|sitzung|anmeldung|link) (?:wurde|ist|konnte) {_W}{{0,3}}(?:blockiert|abgelehnt|gesperrt|abgelaufen|beendet|bearbeitet|ungültig|gültig)\b",
    rf"(?:anmeldung|login) (?:ist )?(?:erforderlich|nötig|notwendig)\b|(?:bitte )?(?:melden sie sich|loggen sie sich) {_W}{{0,4}}(?:an|ein)\b|zu viele (?:anfragen|versuche|verbindungen)\b|(?:bitte )?(?:versuchen|probieren) sie (?:es )?(?:bitte )?(?:später|in|noch)\b|bitte (?:später|warten|in 0|einen moment|kurz)\b|wartungs\w+(?: \S+){{0,6}}$|(?:die|diese|unsere) (?:seite|website|anwendung|der dienst|dienst) {_W}{{0,4}}(?:gewartet|wartung|nicht erreichbar|nicht verfügbar|offline)\b",
    rf"accès (?:est )?(?:refusé|interdit|bloqué|limité|restreint)\b|(?:vous n'avez pas|vous n'êtes pas|vous ne disposez pas) {_W}{{0,4}}(?:droits?|permissions?|autorisations?|autorisée?|accès|connectée?)\b|(?:votre|la|cette) (?:requête|demande|session|connexion) (?:a|est|n'a) {_W}{{0,3}}(?:bloquée|rejetée|refusée|expirée?|terminée|abouti|traitée)\b",
    rf"(?:connexion|authentification|identification) (?:est )?(?:requise|nécessaire|obligatoire)\b|(?:veuillez|merci de) (?:vous )?(?:re)?(?:connecter|identifier|patienter|réessayer|recommencer)\b|trop de (?:requêtes|demandes|tentatives|connexions)\b|réessay(?:ez|er) (?:plus tard|dans|ultérieurement)\b|(?:site|service|page|serveur) (?:est |actuellement |en cours de |en )+(?:maintenance|travaux|construction)\b|revenez (?:plus tard|dans|bientôt)\b|(?:le|ce|notre) (?:site|service|serveur) (?:est|n'est) {_W}{{0,3}}(?:indisponible|disponible|maintenance|fermé|surchargé)\b",
    rf"acceso (?:ha sido |está )?(?:denegado|prohibido|restringido|bloqueado)\b|(?:usted )?no (?:tiene|dispone|está|cuenta) {_W}{{0,3}}(?:permisos?|autorización|autorizado|acceso|derechos)\b|(?:su|la|esta) (?:solicitud|petición|sesión|conexión) (?:ha|fue|está|no) {_W}{{0,3}}(?:bloqueada|rechazada|denegada|caducado|expirado|terminado|finalizado|procesada|completar\w*)\b",
    rf"(?:inicio de sesión|autenticación|identificación) (?:es )?(?:requerid[oa]|necesari[oa]|obligatori[oa])\b|(?:por favor )?(?:inicie|inicia|debe iniciar) sesión\b|demasiad[ao]s (?:solicitudes|peticiones|intentos|conexiones)\b|(?:por favor )?(?:inténtelo|intente|inténtalo|vuelva|pruebe|reinténtelo) (?:de nuevo |otra vez |a intentarlo |nuevamente )?(?:más tarde|en 0|luego|dentro)\b|(?:sitio|servicio|página|servidor) (?:está |actualmente |temporalmente |en )+(?:mantenimiento|construcción|obras)\b|(?:el|este|nuestro) (?:sitio|servicio|servidor) (?:está|no está|no) {_W}{{0,3}}(?:disponible|mantenimiento|cerrado|responde)\b",
    # filler
    rf"lorem ipsum\b|(?:some |more |just |only |this is |this paragraph is |here is |here comes |a bit of |a |the |simply )*(?:dummy|filler|placeholder|sample|example|blind|demo|fake|nonsense) (?:copy|text|content|paragraph|heading|title|sentence|line|headline|section|body|article|words)\b|(?:more |just |only )?(?:filler|placeholder)\b(?: \S+){{0,8}}$",
    rf"(?:your|the|some|more|main|body) ?(?:own |main |actual |real |final )?(?:content|text|copy|title|heading|headline|story|description|paragraph|words|image|details) (?:goes|go|will|comes?|belongs?|to be|to come|should|can go|here)\b",
    rf"(?:text|content|copy|details|description|more|image|information) (?:will (?:be|follow|come|go|appear)|goes|to (?:follow|come|be)|is coming|coming|follows|comes|here)\b|coming soon\b|to be (?:added|written|completed|announced|defined|done|determined|filled)\b|(?:tbd|tba|tbc)$",
    r"(?:please )?(?:replace|delete|overwrite|edit|change|substitute) (?:this|me|these|the) (?:\S+ )?(?:paragraph|text|content|copy|sentence|placeholder|words|line|section|heading|lines)\b",
    r"(?:click|tap|double-click) (?:here )?to (?:edit|add|change|enter)\b",
    r"(?:please )?(?:write|type|add|insert|enter|put) (?:something|your|some|the) (?:\S+ ){0,4}here\b|(?:write|add) something (?:interesting|nice|useful|here)\b",
    rf"(?:dies|das|hier) (?:ist|steht|folgt|kommt|sehen sie|erscheint) {_W}{{0,4}}(?:blindtext|fülltext|platzhalter\w*|beispieltext|mustertext|inhalt|text|dummytext|probetext)\b|(?:blindtext|fülltext|platzhalter\w*|beispieltext|mustertext|dummytext|musterüberschrift|beispielüberschrift|beispielabsatz)\b|(?:bitte )?(?:diesen|diese|den) (?:absatz|text|inhalt|zeile|platzhalter) (?:bitte )?(?:später )?(?:ersetzen|austauschen|ändern|löschen|überschreiben)\b|(?:text|inhalt) (?:folgt|wird (?:später|noch|nachgereicht)|kommt)\b|(?:ihr|dein) (?:text|inhalt)\b",
    rf"(?:ceci|cela|voici) (?:est|n'est)? ?{_W}{{0,3}}(?:texte|paragraphe|contenu)\b|(?:faux|du|un)? ?(?:texte|contenu|paragraphe|titre) (?:à (?:remplacer|venir|compléter)|de (?:remplissage|substitution|démonstration)|d'exemple|d'attente|provisoire|factice|fictif|sera)\b|(?:votre|le|ton) (?:contenu|texte|titre) (?:\S+ )?(?:ici|sera|viendra|va)\b|(?:remplacez|veuillez remplacer|remplacer) (?:ce|cette|le) (?:paragraphe|texte|phrase|contenu)\b|faux texte\b|(?:bientôt disponible|à venir)$",
    rf"(?:este|esto) es {_W}{{0,3}}(?:texto|párrafo|contenido|ejemplo)\b|(?:texto|contenido|párrafo|título) (?:de (?:relleno|ejemplo|muestra|prueba|marcador)|provisional|ficticio|simulado|por (?:añadir|definir))\b|(?:aquí|acá) (?:va|irá|vendrá|se mostrará|aparecerá) (?:su|el|tu) \S+|(?:sustituya|reemplace|cambie|sustituir|reemplazar) (?:este|esta|el) (?:párrafo|texto|frase|contenido)\b|su (?:contenido|texto) (?:va )?aquí\b|(?:próximamente|muy pronto)$",
)
#: Words a segment that begins with a notice may have; a longer one says something else beside it.
LONGEST = 24
_COMPILED = tuple(map(re.compile, NOTICES))
_SCRIPTS = frozenset(("js", "cookie", "cookies"))
_OF_SCRIPTS = tuple(p for p in _COMPILED if _JS in p.pattern)
#: Letters of a segment's first word (up to an apostrophe) by which notices are looked up: it stands in the notice's pattern, or the
#: pattern is one about scripts.
_LETTERS = 6


def _by_beginning() -> dict[str, tuple[re.Pattern, ...]]:
    out: dict[str, list[re.Pattern]] = {}
    for p in _COMPILED:
        if p not in _OF_SCRIPTS:
            for w in {w[:_LETTERS] for w in re.findall(r"[^\W\d_]+|0", re.sub(r"\\.", " ", p.pattern))}:
                out.setdefault(w, []).append(p)
    return {k: tuple(v) for k, v in out.items()}


_BY_BEGINNING = _by_beginning()


#: All notices as one pattern for Arrow's matcher, which reads many segments in one linear pass. It knows ASCII only, so word ends are left
#: out and letters taken for anything but blanks: it refuses nothing that begins with a notice.
_ANY = "^(?:" + "|".join(f"(?:{n.replace(r'\b', '').replace(r'\w', r'\S')})" for n in NOTICES) + ")"


def may_be_notices(segments: list[str]) -> list[bool]:
    """For each segment, whether it may begin with a notice: a test of many at once that refuses none that does."""
    return pc.match_substring_regex(pa.array(segments, pa.large_string()), _ANY).to_pylist()


def is_notice(tokens: list[str], segment: str) -> bool:
    """Whether a segment begins with a notice."""
    if len(tokens) > LONGEST:
        return False
    if any([p.match(segment) for p in _BY_BEGINNING.get(tokens[0].split("'", 1)[0][:_LETTERS], ())]):
        return True
    return not _SCRIPTS.isdisjoint(tokens) and any([p.match(segment) for p in _OF_SCRIPTS])
