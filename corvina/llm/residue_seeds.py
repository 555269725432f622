"""Seed texts from which the models of filler and of server notices are fitted: common knowledge of web pages, composed from
short lists so that wordings not listed whole are covered by their parts."""

from __future__ import annotations

from itertools import product

_THINGS = "page|site|website|app|application|viewer|console|playground|search box|documentation|file listing|diff view|source view|notebook|article|document|file|branch|snippet|listing|repository|resource|content|feed|map|chart|form|dashboard|editor|player|gallery|preview".split("|")

_NEEDS = (
    "needs JavaScript.", "requires JavaScript.", "needs JavaScript to work.", "requires JavaScript to be enabled.", "cannot work without JavaScript.", "does not work without JavaScript.",
    "only renders once JS has run.", "works only with scripts switched on.", "requires a browser with scripts allowed.", "relies on client scripts.", "relies on client-side scripts.",
    "depends on scripting, which seems to be off.", "depends on scripts, which are blocked.", "requires JS.", "cannot be rendered.", "cannot be shown.", "cannot be displayed.", "could not be loaded.", "will not load without scripts.",
)
_GONE = (
    "took too long to answer.", "took too long to respond.", "has been removed or was never here.", "has been moved or deleted.", "is temporarily unavailable.", "is currently unavailable.", "could not be found.",
    "you requested could not be found.", "you are looking for does not exist.", "you asked for is not on this server.", "does not exist on this server.", "is no longer available.", "is not available in your region.",
)

NOTICES = (
    "JavaScript is disabled in your browser. JavaScript is turned off. Turn it on and reload. Please turn JavaScript on and reload the page. Enable it in the settings and refresh. Please enable JavaScript. Enable JavaScript to continue. Please enable JavaScript and cookies to continue.",
    "You need to enable JavaScript to run this app. You must enable JavaScript to view this page. Please switch it on. See how to turn it on. A blocker may be stopping it. An ad blocker may be stopping it. Scripts are blocked. Scripting is disabled.",
    "We noticed that client-side scripting is turned off. Your browser does not run scripts, so the page cannot be shown. Your browser does not support JavaScript. noscript: noscript. Loading... If nothing appears, check that scripting is enabled.",
    "Checking your browser before accessing this site. Please complete the security check. Verify that you are human. Please wait while we check your browser. This process is automatic. You will be redirected shortly. Enable cookies. Cookies are disabled.",
    "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen. Ohne aktivierte Skripte lässt sich die Seite nicht laden. Ohne aktivierte Skripte lässt sich die Ansicht nicht laden. JavaScript ist deaktiviert. Diese Seite benötigt JavaScript. Seite nicht gefunden. Der Verweis ist veraltet oder fehlerhaft. Zugriff verweigert. Interner Serverfehler. Die Seite ist vorübergehend nicht erreichbar. Bitte versuchen Sie es später erneut. Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an. Wartungsarbeiten. Zu viele Anfragen.",
    "Veuillez activer JavaScript pour afficher cette page. JavaScript est désactivé. Cette page nécessite JavaScript. Page introuvable. La page demandée est introuvable. Le lien est périmé ou incorrect. Vérifiez l'adresse. Accès refusé. Accès interdit. Erreur interne du serveur. Le service est momentanément indisponible. Réessayez plus tard. Votre session a expiré. Reconnectez-vous. Trop de requêtes. Maintenance en cours.",
    "Active JavaScript para ver este contenido. Habilite JavaScript para ver esta página. JavaScript está desactivado. Esta página necesita JavaScript. Página no encontrada. Compruebe la dirección. El enlace ha caducado o es incorrecto. Acceso denegado. Error interno del servidor. El servicio no está disponible temporalmente. Inténtelo de nuevo más tarde. Su sesión ha caducado. Inicie sesión de nuevo. Demasiadas solicitudes. Mantenimiento programado.",
    "404 Not Found. HTTP 404. Error 404. Status 404. Page not found. 403 Forbidden. Access denied. Access to this resource is denied. You are not allowed to see this page. You are not allowed to see this document. You lack permission to open this resource. You do not have permission to access this page. Reference #18.2d 1a. 401 Unauthorized. Authorization required.",
    "500 Internal Server Error. Internal server error. 502 Bad Gateway. proxy/1.2. nginx/1.1. 503 Service Unavailable. Service temporarily unavailable. 504 Gateway Timeout. Gateway time-out: the upstream took longer than 300 ms. HTTP 503. Status 500. Error 502. The backend is not answering at the moment, please retry in 30 seconds. The request could not be completed. The request timed out.",
    "upstream connect error or disconnect/reset before headers. upstream connect error or disconnect before headers, reset reason: overflow. reset reason: connection failure. no healthy upstream. Could not connect to database: connection refused (code 111). Error establishing a database connection. connection refused. connection reset by peer.",
    "Warning: include(header.inc): failed to open stream in /srv/app/page.php on line 12. Fatal error: Uncaught exception in /var/www/html/index.php on line 40. Warning: mysql_connect(): in /srv/app/db.php on line 3. Parse error: syntax error, unexpected end of file in /srv/app/menu.php on line 9. Notice: Undefined index in /srv/app/list.php on line 7. No such file or directory in /srv/app/main.php on line",
    "Something went wrong on our side. Something went wrong. We have been told about it. Our team has been notified. Request id: 4f. Trace a0fc, node 3. The incident was logged under 0d. Oops. Oops! Uh-oh! Sorry. Sorry, Notice. Error: Warning: We were unable to show this page. We were unable to show this article. We were unable to show this file. An unexpected error occurred. An error occurred while processing your request. The server failed while it prepared the page. The server encountered an error.",
    "Too many requests. Slow down and come back later. You have opened this file too often in a short time. You have opened this page too often in a short time. You have reached the request limit. Rate limit exceeded. Try again later. Try again in a little while. Please try again in a few minutes. Please come back later. Contact the operator if this goes on. Contact the administrator if the problem persists. Go back or use the search box. Return to the start page. Check the spelling of the address. Check the address. It may have moved, or the address was typed wrongly. The link to this page has expired. The link to this file has expired. The link may be broken. The link to this",
    "Your session has expired. Sign in again to continue. Log in and reload. Please log in to continue. Sign in to view this content. You must be logged in to see this page. This content is temporarily unavailable. This content is not available. Scheduled maintenance is under way. We are down for maintenance. The site is under maintenance. We will be back soon. The service behind this page is down. The service behind this file is down. Please allow scripts for this site to see the file listing. Please allow scripts for this site. This account has been suspended.",
    "Whoops! Whoops, there is nothing here. There is nothing here. Nothing to see here. Nothing lives here. Nothing was found at this address. Nothing found at this URL. This URL does not exist. The URL you entered is invalid. No page exists at this address. You seem to be lost. Oh no! We could not load that page. We could not load this content. We could not find that page. We can't find the page you are looking for. That page is gone. The requested URL was not found on this server. 410 Gone. This page isn't working. This site can't be reached. Took too long to respond.",
    "Checking that you are human. Checking that you are not a robot. Are you a robot? We have detected unusual traffic from your network. Please solve the captcha. Complete the captcha to continue. This takes a few seconds. This may take a few seconds. Please stand by. Your connection is being checked. Access from your country is blocked. Your IP address has been blocked. You have been blocked. Request blocked. 429 Too Many Requests. Slow down. Please slow down and try again. Come back later.",
    "Sorry, this repository is private or does not exist. This repository is private. This project is private or has been deleted. This account is private. This item is no longer available. This post has been removed by its author. You need permission. Ask the owner for access. Request access. Subscribe to continue reading. This content is for members only. Your trial has expired. Please update your browser. Your browser is not supported. Your browser is out of date. Cookies must be enabled. Certificate has expired. Your connection is not private.",
    "Die angeforderte Seite existiert nicht. Die Datei wurde nicht gefunden. Sie haben keine Berechtigung, diese Seite zu sehen. Der Dienst ist zurzeit nicht verfügbar. Fehler 404. Es ist ein Fehler aufgetreten. Bitte laden Sie die Seite neu. Ihr Browser unterstützt kein JavaScript. Bitte bestätigen Sie, dass Sie kein Roboter sind.",
    "Cette page n'existe pas ou plus. Le fichier demandé n'existe pas. Vous n'avez pas l'autorisation de consulter cette page. Une erreur est survenue. Erreur 404. Erreur interne du serveur. Veuillez recharger la page. Votre navigateur ne prend pas en charge JavaScript. Confirmez que vous n'êtes pas un robot. Le site est en maintenance.",
    "La página solicitada no existe. No se encontró el archivo. No tiene permiso para ver esta página. Se ha producido un error. Error 404. Vuelva a cargar la página. Su navegador no admite JavaScript. Confirme que no es un robot. El sitio está en mantenimiento. Servicio no disponible.",
    *(f"The {t} {n}" for t, n in product(_THINGS, (*_NEEDS, *_GONE))),
    *(f"This {t} {n}" for t, n in product(_THINGS, (*_NEEDS, *_GONE))),
    *(f"Our {t} {n}" for t, n in product(_THINGS[:12], _NEEDS)),
    *(f"{a} this {t}{b}" for t in _THINGS for a, b in (("We were unable to show", "."), ("You are not allowed to see", "."), ("The link to", " has expired."), ("The service behind", " is down."), ("You have opened", " too often in a short time."), ("The server failed while it prepared", "."))),
)

#: Navigation that surrounds sound pages as well as notices, and so speaks for neither.
CHROME = (
    "Sign in Register. Sign in   Register. Sign up. Log in. Log out. My account. Imprint - Privacy - Terms. Imprint. Privacy policy. Terms of use. Skip to content. Skip to main content. Home | Files | Issues | Help. Home | About | Contact. Search this site. Search this website. Search. Back to start page. Back to top. Back to home page. Start page. Share this page. Print this page. Cookie settings. All rights reserved. Next page. Previous page. Table of contents. Contact. About us. Menu. Navigation. Subscribe. Follow us.",
)

#: The usual stock of Latin filler, of dummy words and of keyboard runs.
LATIN = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum morbi mattis luctus varius porta pretium viverra gravida congue felis libero sodales fusce rutrum tortor dapibus semper ullam labora nostra incidunt porttitor vestibulum pellentesque curabitur vivamus phasellus ultrices faucibus tristique".split()
DUMMY = "bla blah text words more".split()
KEYS = "asdf qwer sdfg fdsa hjkl jkl xyz asd zxcv qwerty yxcv uiop wer dfgh".split()
FILLER = (
    "T.B.D. T.B.A. TBD. TODO. To be done. To be written. Coming soon. Coming soon! Content to follow. Text to follow. More to come. Section under construction. This page is under construction. Under construction. Work in progress. Nothing here yet.",
    "Your description goes here. Your text goes here. Your text here. Insert text here. Enter your text here. Replace this paragraph with real content. Replace this text with your own. Add a short introduction in this section. Add a description here. Two or three sentences are enough. Write something about your module here. Write something about your project here. Describe your project here. Edit this block before you publish it. Edit this text before you publish it. This is a sample paragraph. Sample text. Placeholder text. Dummy text. This is dummy text. Heading one. Heading two. Heading three. Paragraph one of the starter page. Paragraph two of the starter page. Paragraph three of the starter page. Title goes here. Subtitle goes here. Click to add text. Just another site. Hello world, this is your first post.",
    "Beispieltext Beispieltext Beispieltext. Hier steht später die Beschreibung. Hier steht Ihr Text. Bitte diesen Blindtext ersetzen. Dies ist ein Blindtext. Inhalt folgt. Text folgt. Demnächst mehr. In Bearbeitung. Im Aufbau. Platzhaltertext. Beschreibung einfügen.",
    "Texto de ejemplo. Sustituya este párrafo por el suyo. Sustituya este texto por el suyo. Aquí va su texto. Aquí irá la descripción. Texto de relleno. Próximamente. En construcción. Contenido pendiente. Escriba aquí su texto.",
    "Texte d'exemple à remplacer avant la mise en ligne. Texte d'exemple. Remplacez ce paragraphe par le vôtre. Votre texte ici. La description viendra plus tard. Texte de remplissage. Bientôt disponible. En construction. Contenu à venir. Faux texte à remplacer.",
)

#: Natural prose on software, errors and scripts included: it steadies the natural model of small collections.
NATURAL = (
    "See [the guide](https://example.org/guide/a_b) and the [index] for 5% of the cases, about $3 each.\nThe notes [1] and [2, 3] are by @lee; #12 is done (see below).\nTypes such as List<String> or Map<Key, Value> and names such as max_size or __init__ are kept.\nTHE WHOLE PAGE (A, B) IS SET IN CAPITALS: 100% OF IT.\n- [x] a task that is done\n- [ ] a task to do\n{a, b} is a set, and x < y < z holds.",
    "The bundler compiles the modules and writes one file per entry. JavaScript modules have to be enabled in the bundler; the option is called mode. The option is set in the configuration of the build. Our build needs Python packages to be enabled in the lock file.",
    "The server answers with an error when the key is missing, and the client retries the request. Users who see the message should clear the cache. The test checks that the response is denied without a token. We log the message and open a new session. The crawler skips pages without a body.",
    "The function returns the sorted values and keeps the order of equal keys. Each node owns a list of edges; nothing else may change it. We measured the time of each step and compared the results. The index holds one row per term. If the file is missing, the default is read. Call the method before the handle is closed.",
    "Das Modul hält genau einen Eintrag vor. Fehlt der Schlüssel, gilt der Wert der Vorgabe. Le module conserve une seule entrée par clé. Si la clé manque, la valeur par défaut est prise. El módulo guarda una sola entrada por cada clave. Si falta la clave, se usa el valor por defecto.",
)

#: The usual ways in which template languages and people mark a slot, %s being its name.
SLOT_MARKS = (
    "{{%s}}", "{{ %s }}", "{{{%s}}}", "{{#%s}}", "{{/%s}}", "{%s}", "${%s}", "#{%s}", "<%%= %s %%>", "<%%=%s%%>", "<%% %s %%>", "{%% %s %%}", "{%% block %s %%}{%% endblock %%}", "%%(%s)s", "%%(%s)d",
    "[[%s]]", "[[ %s ]]", "@@%s@@", "__%s__", "%%%s%%", "%%%%%s%%%%", "$%s$", "«%s»", "<%s>", "<< %s >>", "<<%s>>", "XXX", "XXXX", "XXXXX", "XX/XX/XXXX",
)
SLOT_WORDS = (
    "[insert %s here]", "[INSERT %s HERE]", "[your %s here]", "[YOUR %s]", "[your %s]", "[enter %s]", "[add %s here]", "[%s here]", "[%s goes here]", "[put %s here]", "[fill in %s]",
    "<your %s>", "<your %s here>", "<insert %s>", "<insert %s here>", "<enter %s>", "{your %s}", "{insert %s}", "(%s: TBD)", "(%s: TODO)", "(%s: TBA)", "(%s to be defined)",
    "[votre %s ici]", "[insérer %s ici]", "[votre %s]", "[Ihr %s hier]", "[%s einfügen]", "[%s eintragen]", "[hier %s einsetzen]", "[aquí va %s]", "[su %s aquí]", "[inserte %s aquí]",
)
SLOT_BARE = ("%s: TBD", "%s: TBA", "[object Object]", "[TBD]", "[TODO]", "[TBA]")
_NAMES = "name|first name|last_name|company|companyName|company name|email|phone number|address|city|date|start_date|price|order.id|product|product_title|url|description|amount|NAME|DATE|COMPANY_NAME|CITY|EMAIL|User.Name|customer|customer_id|0|1|12|i|item|count".split("|")
_PLACES = ("%s", "text %s text", "Text %s.", "%s text", "text: %s", "%s, text", "Text %s!", "# %s", "- %s", "text (%s) text")

#: Sound uses of the same marks.
SOUND_MARKS = ("(%s)", "(%s, %s)", "[%s](https://example.org/%s)", "[%s]", "[see %s]", "[1]", "[2, 3]", "[x]", "@%s", "#12", "#%s", "%s_id", "%s[0]", "%s(%s)", "5%%", "$5", "$1.50", "%s: %s", "%s < 5", "%s > 5", "%s -> %s", "a/%s/%s.txt", "%s = %s", "- [ ] %s", "%s & %s", "C++ %s", "*%s*", "**%s**", "_%s_", "~%s~", "%s|%s")


def sound() -> list[str]:
    """Lines in which marks stand for themselves."""
    return [place % m.replace("%s", n).replace("%%", "%") for place in _PLACES for m in SOUND_MARKS for n in ("name", "first name", "Type", "API", "x")]


def slots() -> tuple[list[str], list[str]]:
    """(lines for the model of shapes, lines for that of wordings). In wordings the name is a symbol that no text has, so that only the
    words and marks around it are learned; in shapes any name does."""

    def named(form: str, name: str) -> str:
        if "%s" not in form:
            return form
        return form % (name.upper() if form in ("__%s__", "%%%s%%", "%%%%%s%%%%", "$%s$", "«%s»") else name)

    boxed = [f"[{a} {b}]" for a in ("COMPANY", "YOUR", "FULL") for b in ("NAME", "ADDRESS")]  # of one word alone it would be a tag
    # square and round brackets in small letters are links and notes as well: only their wording counts
    forms = (*SLOT_MARKS, *(f for f in SLOT_WORDS if f[0] in "<{" or f.isupper()))
    shapes = [place % x for place in _PLACES for x in [*boxed, *(named(f, n) for f in forms for n in _NAMES)]]
    wordings = [place.replace("text", "\x05").replace("Text", "\x05") % named(f, "\x05") for place in _PLACES for f in (*SLOT_WORDS, *SLOT_BARE)]
    return shapes, wordings
