"""A classifier of single lines: content, error message, filler, or a notice that scripts are required.

A softmax regression over classes of words, where they stand, how they meet, the line's length,
its share of function words and the words themselves. It is fitted on the lines below,
which were written for it: messages that web servers, browsers, applications and page builders show,
and beside them prose that reports, explains or plans such things. Fitting is the same everywhere
and takes a fraction of a second, so each process does it once.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

KINDS = ("content", "error", "filler", "script")

# Words by class, in English, German, Spanish and French.
CLASSES = {
    "fault": "error errors fault failed fails failure fehler erreur erreurs código codigo denied forbidden unauthorized unauthorised unavailable broken exception traceback expired refused reset invalid missing timeout overloaded crashed wrong unexpected unknown fatal occurred introuvable indisponible gefunden verfügbar verweigert abgelaufen encontrada encontrado disponible denegado caducado refusé trouvée expirée échoué fehlgeschlagen existiert existe problem problema problème",
    "negation": "not no cannot can't couldn't could can doesn't don't unable longer nicht kein keine no non pas ne plus",
    "place": "page site website url link server gateway service app application file resource content request connection session view address host backend upstream handler seite inhalt dienst página sitio servidor contenido servicio contenu serveur lien document dashboard portal panel wiki board",
    "sorry": "sorry oops whoops uh oh hoppla ups leider désolé désolée entschuldigung lo sentimos apologies whoa",
    "reader": "you your you're sie ihr ihre ihrem ihren su sus usted vous votre vos",
    "again": "try retry reload refresh again later back return start home versuchen später erneut neu laden zurück startseite vuelva vuelve intente intentar recargar inicio más tarde réessayer réessayez recharger retour accueil retournez contact administrator owner support network slow",
    "login": "login log sign signin logged signed account permission permissions access rights anmelden sesión connecter reconnecter connectez zugriff acceso accès list allowed authorised authorized",
    "loading": "loading load laden lädt cargando chargement null undefined nan none nil object",
    "scripts": "javascript script scripts cookies cookie noscript jscript clientside",
    "enable": "enable enabled activate allow turn switch enabling aktivieren aktiviert active activar activez activer habilite permita autorisez disabled deaktiviert desactivado désactivé blocked blockiert bloqueados needs need requires require required erforderlich benötigt necesita requiere nécessite requis relies depends without ohne sin sans",
    "browser": "browser browsers navegador navigateur update features support supported unterstützt",
    "sample": "sample dummy placeholder filler example lorem ipsum blindtext platzhalter beispieltext ejemplo relleno prueba muestra exemple remplissage fictif provisoire",
    "fill": "insert enter type write add edit click replace paste fill eintragen einfügen ersetzen hier here aquí ici sustituir reemplazar insertar escriba remplacer insérer saisir goes folgt follows venir steht soon coming construction untitled new picking layout publishing publish block box field writing",
    "text": "text texts paragraph title heading description summary body caption texto título párrafo texte titre paragraphe titel absatz überschrift beschreibung",
    "mash": "asdf qwer qwerty hjkl jkl xxx xxxx blah bla foo bar test testing abc zzz",
    "report": "after because during when while was were had caused saw returned users customers clients we our incident yesterday last week means meant shows showed fixed removed added so since until then before why if once graph rolled noticed deploy cutover owner explains logged review nach weil während wurde wurden wir unser después porque durante cuando fue hemos nuestro après parce pendant quand était nous notre",
}
_CLASS_OF: dict[str, list[str]] = {}
for _name, _words in CLASSES.items():
    for _w in _words.split():
        _CLASS_OF.setdefault(_w, []).append(_name)
# The small words without which prose of some length is rare.
FUNCTION_WORDS = frozenset(
    "the a an of to in is are was were and or for on at by with from it its that this be as not no if when we you they after before until than then who all each both only do does did has have"
    " der die das den dem des ein eine und oder zu im am ist sind war wird nicht mit von für auf bei nach wenn bis es wir sich"
    " el la los las un una de del y o en es son fue no con por para que se al si su"
    " le les des du et ou est sont a à dans pour par sur qui que ne pas ce il nous vous au aux en".split()
)
_CODE = re.compile(r"\b(?:4(?:0[0-9]|1[0-9]|2[0-9]|51)|5(?:0[0-9]|1[01]|2[0-9]|3[0]))\b")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|§|#|@")
_NAME = re.compile(r"\b\w+(?:[-_/.]\w+)+\b|\b\w*\d\w*[^\W\d]\w*\b")
_NUMBER = re.compile(r"\d+(?:[.,:]\d+)*")

# Lines written for fitting. They are of no use as patterns: the classifier sees their features only.
LINES = {
    "error": """
404 Not Found|404 - page not found|404. That's an error.|Error 404|HTTP 404|HTTP Error 404: the file was not found|The requested URL was not found on this server.|The page you are looking for does not exist.|This page could not be found.|Page not found|Sorry, this page isn't available.|We can't find that page.|Oops! That page can't be found.|The link you followed may be broken.
Not found|Not found.|Too many requests.|Too many connections|The server is down for maintenance.|The site is down for repairs.|We looked for it, but the page is gone.|The address may be wrong or the page was removed.|The link may be wrong or out of date.|The connection was reset while the page was loading.|The request timed out after 60 seconds.|This page timed out.|Something broke on our end.|Something went wrong at our end.|You are not on the list of members for this page.|500 Internal Server Error|Internal server error|502 Bad Gateway|Bad gateway|503 Service Unavailable|Service temporarily unavailable|504 Gateway Time-out|Error 524: a timeout occurred|Error 522: connection timed out|Gateway timeout|The server returned an invalid response.|The server is temporarily unable to service your request.|The server is overloaded.|We're sorry, but something went wrong.|Something went wrong|Something went wrong. Please try again.|An unexpected error occurred.|An error has occurred.|An unknown error occurred.|Unexpected error
Application error: a client-side exception has occurred|Application error|Uncaught TypeError: cannot read properties of undefined|Traceback (most recent call last):|NullPointerException at line 12|Fatal error: uncaught exception|Exception in thread main|Stack trace:|Traceback: the page could not be rendered|Traceback: template not found|Template could not be rendered|Rendering failed: missing template|Template error (line 12)|Error: connection refused|Connection refused|The connection was reset|The connection has timed out|The connection was closed by the server.|Request timed out|This request timed out.|This site can't be reached|The site is down.|Could not connect to the server.|Unable to connect|Failed to fetch|Failed to load resource|Failed to load the content.|The content could not be loaded.|This view could not be loaded.|Could not load this view.
Access denied|Access to this page has been denied.|You don't have permission to access this page.|You do not have access.|You don't have the rights to view this.|You are not authorized to view this page.|You are not on the access list.|You are not allowed here.|403 Forbidden|Forbidden|Forbidden.|401 Unauthorized|Unauthorized|Permission denied|Authentication required|Login required|You must be logged in to view this page.|Please log in to continue.|Please sign in to continue.|Sign in with your account.|Log in again to continue.|Sign in again.|Your session has expired|Session expired. Please log in again.|Your session timed out.|Your session has ended.
Too many requests|429 Too Many Requests|Rate limit exceeded. Please slow down.|Slow down and try again in 30 seconds.|Please try again later.|Try again in a few minutes.|Please try again in a moment.|Reload the page.|Reload or go back.|Go back to the home page|Back to the start page|Return to the homepage|Contact the site owner.|Contact the site administrator if the problem persists.|Please contact support.|Check your network connection.|Check the network and retry.|Whoops, looks like something broke.|Oops, an error occurred.|Oops! We could not load this.|Uh oh, an error.|Sorry, we could not load that.|Sorry, an error occurred.|Page unavailable|This page is unavailable.|Service unavailable.|Site unavailable|Content unavailable|Content not available|No handler for this request.|No route for this address.|No backend answered.|The upstream server gave no response.|The backend closed the connection.|This page has moved or no longer exists.|This page is gone.|The page is gone.|Error code: 9|Error
Loading|Loading...|Please wait while the page loads...|null|undefined|NaN|None|[object Object]|null null|nil
Seite nicht gefunden|Diese Seite wurde nicht gefunden.|Die Seite existiert nicht.|Fehler 404|Fehler 500|Fehler beim Laden|Fehler beim Laden der Seite.|Zugriff verweigert|Dienst nicht verfügbar|Bitte versuchen Sie es später erneut.|Ihre Sitzung ist abgelaufen.|Ein Fehler ist aufgetreten.|Zur Startseite|Zurück zur Startseite|Bitte melden Sie sich an.
Página no encontrada|Pagina non trovata|Error 404: página no encontrada|Acceso denegado|Servicio no disponible|La página no existe.|Vuelva a la página de inicio.|Volver al inicio|Ha ocurrido un error.|Inténtelo de nuevo más tarde.|Su sesión ha caducado.|Error del servidor
Page introuvable|Cette page n'existe pas.|La page demandée est introuvable.|Accès refusé|Accès refusé (erreur 403)|Erreur 500|Erreur 404|Service indisponible|Une erreur est survenue.|Veuillez réessayer plus tard.|Votre session a expiré.|Veuillez vous reconnecter.|Retour à l'accueil
""",
    "script": """
Please enable JavaScript.|Please enable JavaScript to continue.|Please turn JavaScript on and reload the page.|You need to enable JavaScript to run this app.|JavaScript is required|JavaScript is required to view this page.|JavaScript is disabled in your browser.|JavaScript disabled|This site requires JavaScript.|This page needs scripts.|This application requires cookies and JavaScript.|Our site relies on JavaScript.|Enable JavaScript and cookies to continue|Cookies are required|Cookies must be enabled|Turn on cookies and reload.|Turn them on in your browser settings.|Switch scripts on and reload this page.|Allow scripts to run and try again.|Scripts are blocked|If the page stays empty, check whether scripts are blocked.|If nothing loads, make sure that scripts are allowed.|If nothing shows, check that scripts are not blocked.|Your browser does not support JavaScript.|Your browser doesn't support the features this page needs.|Your browser is not supported. Please update it.|Update your browser and allow scripts.|Update it, then allow scripts.|noscript: page unavailable without client-side rendering|This page cannot be shown without JavaScript|You have to allow cookies before the page can be displayed.|Please activate JavaScript in your browser
Bitte aktivieren Sie JavaScript.|Bitte aktivieren Sie JavaScript in Ihrem Browser.|JavaScript ist deaktiviert.|JavaScript ist erforderlich.|Für diese Seite muss JavaScript aktiviert sein.|Cookies müssen aktiviert sein.|Por favor, active JavaScript.|Active JavaScript en su navegador.|Active los scripts para ver la página.|Debe habilitar JavaScript para ver esta página.|JavaScript está desactivado.|Veuillez activer JavaScript.|Veuillez activer JavaScript pour afficher cette page.|Activez JavaScript dans votre navigateur.|JavaScript est désactivé.|Cette page nécessite JavaScript.
""",
    "filler": """
Lorem ipsum dolor sit amet, consectetur adipiscing elit.|Lorem ipsum|Sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.|Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris.|Duis aute irure dolor in reprehenderit in voluptate velit esse.|Sed ut perspiciatis unde omnis iste natus error|Nemo enim ipsam voluptatem quia voluptas|Excepteur sint occaecat cupidatat non proident|Vivamus sagittis lacus vel augue laoreet rutrum|Curabitur blandit tempus porttitor|Integer posuere erat a ante venenatis|At vero eos et accusamus et iusto odio
Sample text|Sample text here.|Sample text goes here.|Dummy text|Placeholder text|This is placeholder text.|This is a sample page.|This is an example page.|This is a dummy paragraph.|This is a dummy paragraph to show the layout.|Example content|Filler text|Text goes here|Your text here|Add your text here.|Insert text here|Insert your text here|Insert text.|Enter text here|Enter a description here|Enter a short description in this field.|Enter a title|Type a summary here|Type something|Enter a short summary of the page in this field.|Add a short text about the team in this block.|xxxxx xxx xxxx xx|xxx xxxx xxxxx xxxx|Write a short description of the page here.|Add a title|Add a description|Click here to edit.|Click here to edit this text.|Click to add a title|Start writing here|Start typing or choose a template.|Start writing or choose a layout.|Replace this text.|Replace this before publishing.|Replace me|Replace it with your own text.|New page|Untitled|Untitled page|Untitled document|Coming soon|Under construction|Content goes here|Content to follow|Description goes here
asdf asdf|asdf asdf asdf|asdf jkl asdf|qwerty qwerty|test test test|test test|blah blah blah|bla bla bla|foo bar foo bar|xxx xxx xxx|xxxx xxxx|zzz zzz
Text folgt|Text folgt.|Inhalt folgt|Beschreibung folgt|Blindtext|Das ist ein Blindtext.|Hier steht ein Beispieltext.|Hier steht bald der Text.|Hier Text einfügen|Hier klicken zum Bearbeiten|Platzhalter|Ersetzen|Texto de ejemplo|Contenido de ejemplo|Texto de relleno|Texto de prueba|Inserte su texto aquí|Escriba aquí el texto|Sustituir|Reemplazar este texto|Texte d'exemple|Texte à venir|Contenu à venir|Contenu d'exemple|Insérer le texte ici|Saisir le texte ici|Remplacer|Remplacer ce texte|Page en construction|Página en construcción
""",
    "content": """
Clients saw a 502 for half a minute, then recovered.|The gateway returned 504 while the pool was drained.|A 404 from the probe means that the route is missing in this build.|We raised the timeout because requests failed under load.|Users reported that the page was not found after the rename.|The error rate fell to 0.2 percent after the rollback.|Errors of this kind are logged and counted.|The server was overloaded during the sale, so we added two nodes.|If the connection is refused, check the firewall first.|When access is denied, ask the owner of the group.|Access is granted by the security team.|A session expires after thirty minutes.|The login page moved to a new host.|We log in with hardware keys.|The retry budget is three attempts.|Retry the job once if it fails.|Try the second replica before paging.|Refresh the cache at night.|Reload the configuration with a signal.|Go back to step two if the check fails.|Contact the owner of the service before the change.|The network team checks the link each week.|Loading the table takes ten minutes.|The load on the database doubled.|Null values are stored as empty strings.|The field is undefined in old records.|Internal server errors were caused by a full disk.|Too many requests came from one tenant, so we set a limit.|The rate limit is 500 requests a minute.|Forbidden words are listed in the policy.|The file was not found because the path had changed.|The page explains how to read error codes.|The service is unavailable on Sundays between two and four.|Maintenance is planned for Sunday.|The backend closes idle connections after a minute.|The upstream pool has four members.|No handler was registered, which the fix in the last release adds.|The message access denied comes from an old token.|An exception list is kept by the team.|The unknown host turned out to be a printer.|The failed drive was replaced.|Broken links are found by a weekly job.|The wrong limit was set on Monday.|A fatal crash was seen once in March.
The panel needs JavaScript modules compiled by the job; they were rebuilt.|Scripts in the folder are run each night.|The script rotates the keys.|Cookies are set for thirty days.|Cookies are required for baking day.|The browser test suite runs in an hour.|Our JavaScript bundle grew by ten percent.|Enable the flag after the review.|Enable compression on the proxy.|Turn on the second pump.|Allow ten minutes for the switch.|The feature requires version 4.|JavaScript errors are sent to the collector.|Users without JavaScript see a static page, as the design asks.|We support two browsers.|Update the agent and restart it.
We removed the lorem ipsum draft last week.|The sample rate is ten percent.|Sample the queue every five minutes.|The example shows how to call it.|Add a title to the report before you send it.|Enter the code in the form.|Type the name of the cluster and press return.|Click here is bad link text, as the style guide says.|Replace the filter each spring.|Replace the disk and start the rebuild.|Insert the card into the slot.|Write the number on the label.|The new page was published on Friday.|New pages are reviewed by two people.|The text follows the house style.|Test the backup each month.|The test took an hour.|Test runs start at noon.|Tests passed.|The title field has a limit of 80 letters.|The description was too short.|Content is copied to the mirror at night.|A placeholder value is replaced at publish time.|Under construction since May, the bridge opens in autumn.
We agreed to keep the timeout at 30 until May.|We agreed to keep the size of the pool at 12 until the disk is replaced.|They want to keep the memory limit at 64 until the host is replaced.|Check the valve before you change the limit; two people must review the change.|Check the service before you change the timeout.|Rollback means setting the connection limit back to 20 and watching the graph.|The error budget is spent.|We keep the error budget at 40 until the network is rebuilt.|The request size is 9 megabytes.|The memory request is 512.|the pump at fault|at fault|The network is at fault.|the disk at fault, as seen twice|blame the loader, not the network|a fault in the loader|fault|Compare: fault|Compare: 9 rows|Compare: the drain failed|failed|failed twice|a lost lease?|a missing key?|an unbounded queue?|rate read 9|count read 12|sorting old boxes.|tagging old files.|Back to the old limit, although the review said otherwise.|back to the first cell, since the other was full|It is safe to ignore errors in the first minute after a change.|Requests were retried and nothing was lost.|Clients saw an error page for some seconds, then it was gone.|Visitors saw a 503 page for a minute during the switch.|This is short text.|This is a long sentence.|This text is short.|That is the new text.|The connection pool has ten slots.|connection pool|request timeout|error rate|handshake errors per cell|The service returned to normal.|The service writes its state to the file.|No service was lost.|Requests to the address are logged.|The resource is shared by two teams.|The content of the file is checked twice.|The application reads the file at start.|The server room is on the second floor.|A view of the queue is on the wall.
Der Grenzwert liegt bei 12 Stufen pro Gruppe.|Die vereinbarte Zahl beträgt 40 Läufe je Stunde.|Der Richtwert gilt pro Woche und je Team.|Vor jedem Wechsel zählt die Schicht alle offenen Posten.|Danach laufen alle Aufgaben wieder auf dem alten Knoten.|Niemand bemerkte den Ausfall der zweiten Pumpe.|El valor acordado es de 12 pasos por grupo.|El equipo cuenta cada hora los puestos abiertos.|Nadie notó la caída de la segunda bomba.|La valeur convenue est de 12 étapes par groupe.|Chaque équipe compte les postes ouverts par heure.|Personne n'a vu la panne de la seconde pompe.|Someone stepped in; what should the team verify next?|what should the lead verify next?|kept training new people.|given slow disks|given slow disks and a full queue,|despite a lost lease,|an old valve hidden which nobody mentions.|listed double writes first although the log said otherwise.|If three probes agree, every node moves.|of 12 probes seen, two were late|tuning a pump.|with 12|while others kept sorting old boxes,|under heavy load, the reviewer named the pump as origin
Home | Products | About us | Contact|Home | News | Team|Home|Menu|Search|Skip to content|Skip to main navigation|Log in|Log in Register Help|Sign in Search|Log out|Intranet > Guides > Network|Docs > Limits|Share this page|Print this page|Last updated on Monday|All rights reserved|Previous Next|Page the second line first.|Page the lead if it stays red.|Page the owner|Page 3 of 7|page|It failed.|The drain failed twice.|the valve was at fault.|Compare: the pump at fault.|Compare the two runs.|An endless retry?|no retry|Request a1b2c3d4|Request 4f7e was slow.|queue depth, then the cache|node pool.|Rollback means setting the limit back and watching the queue for ten minutes.|whoever held it hid the clock step|the batch queued more batches although nobody said so|heap usage read 88; what should the team check next?|which the ticket never mentions, although it should|reading it backwards, the team lost leases|moved onto other nodes except where pinned|quoted twice except where empty|empty responses, though the log never mentions them
Hello|Status: green|Summary|Owner|Notes|Rollback steps|Next steps|Overview|Checklist|Contact|Contacts: see the roster|Retention|Limits and quotas|On-call rotation|Change log|See also|Agenda|Action items|Decision|Risks|Scope|The lease is renewed every ten seconds.|Ask the owner for the token.|Two reviewers must sign.|The cache writes its state to disk.|Drain the node and wait for the queue.|Keep it in read mode.|The quota is 40 percent.|Nobody noticed.|It was slow.|Done.|Agreed.|Yes.|ok, thanks|looks good to me|Can you check the dashboard?|I will look at it.|The dashboard shows the depth of the queue.|The site in the north has two halls.|The board meets on Tuesday.|The wiki has a page on this.|Open the panel and read the value.|Your report is due on Friday.|You can find the runbook in the wiki.|If you are paged, start with the graph.|Sign the form and send it back.|The account team owns the list.|Der Dienst wurde nach dem Wechsel neu gestartet.|Die Seite beschreibt den Ablauf.|Der Fehler trat nach dem Update auf.|Wenn der Zugriff fehlt, fragen Sie das Team.|Der Text wird jede Nacht kopiert.|El servicio se reinició después del cambio.|La página describe los pasos.|El error apareció después de la actualización.|Si no hay acceso, pregunte al equipo.|Le service a redémarré après la bascule.|La page décrit les étapes.|L'erreur est apparue après la mise à jour.|Si l'accès manque, demandez à l'équipe.|Der Eigentümer prüft die Liste jede Woche.|El dueño revisa la lista cada semana.|Le propriétaire vérifie la liste chaque semaine.
the pool keeps forty connections|limit is 200|owner changed to the edge team|moved to the second cell|step 3 wait ten minutes|check that the value is above the line|restart twice if the probe is red|page the second line when the first does not answer|send the export to the mailbox|window opens at noon and closes at two|the mirror is off during the test|three nodes were lost and came back|count the rows and compare|no alerts fired
""",
}


def reduced(line: str) -> str:
    """The line without case, names and numbers; a status code is a sign of its own."""
    low = _NAME.sub(" @ ", line.casefold().replace("’", "'").replace("client-side", "clientside"))
    return _NUMBER.sub(" # ", _CODE.sub(" § ", low)) if any(c.isdigit() for c in low) else low


def features(low: str) -> list[str]:
    """Features of a ``reduced`` line."""
    words = _TOKEN.findall(low)
    n = len(words)
    size = "1" if n <= 1 else "2" if n <= 2 else "4" if n <= 4 else "7" if n <= 7 else "12" if n <= 12 else "20" if n <= 20 else "long"
    small = sum(w in FUNCTION_WORDS for w in words)
    share = "0" if not small else "lo" if small * 5 < n else "mid" if small * 5 < 2 * n else "hi"
    found: dict[str, int] = {}
    for i, w in enumerate(words):
        for c in _CLASS_OF.get(w, ()):
            found.setdefault(c, i)
    names = sorted(found)
    f = ["b", "size:" + size, f"small:{share}|{'s' if n < 6 else 'l'}"]
    f += ["c:" + c for c in names] + [f"c:{c}|{size}" for c in names] + [f"c1:{c}" for c in names if found[c] == 0]
    f += [f"cc:{a}+{b}" for i, a in enumerate(names) for b in names[i + 1 :]]
    if "§" in words:
        f += ["code", "code1" if words[0] == "§" or (n > 1 and words[1] == "§") else "codein", "code|" + size]
    f += [x for x, y in (("@", "has@"), ("#", "has#")) if x in words for x in (y, f"{y}|{size}")]
    hit = sum(1 for w in words if w in _CLASS_OF or w == "§")
    f.append(f"hit:{4 * hit // max(1, n)}|{'s' if n < 6 else 'l'}")
    if n >= 5 and not small:
        latin = sum(w.endswith(_LATIN_ENDS) for w in words)
        f.append(f"latin:{4 * latin // n}")
    if n >= 2 and len(set(words)) * 2 <= n:
        f.append("repeats")
    f += ["w:" + w for w in set(words)]
    return f


# Endings that Latin words have more often than those of the languages read.
_LATIN_ENDS = ("us", "um", "is", "it", "at", "am", "ae", "que", "ur", "os", "nt", "ra", "or", "unt", "ibus", "orum", "a")


@lru_cache(maxsize=1)
def weights() -> tuple[dict[str, int], np.ndarray]:
    """(number of each feature, weights by feature and kind), fitted on ``LINES``: gradient descent with a penalty, words weighing half."""
    rows, gold = [], []
    for k, kind in enumerate(KINDS):
        for line in re.split(r"[|\n]", LINES[kind]):
            if line.strip():
                rows.append(features(reduced(line.strip())))
                gold.append(k)
    index = {f: i for i, f in enumerate(sorted({f for r in rows for f in r}))}
    x = np.zeros((len(rows), len(index)))
    for i, r in enumerate(rows):
        for f in r:
            x[i, index[f]] = 0.5 if f.startswith("w:") else 1.0
    y = np.eye(len(KINDS))[gold]
    each = y.sum(axis=0)
    balance = (y @ (len(gold) / (len(KINDS) * each)) ** 0.5)[:, None]
    w = np.zeros((len(index), len(KINDS)))
    for _ in range(400):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= 0.5 * (x.T @ (balance * (p - y)) / len(gold) * 4 + 0.002 * w)
    return index, w


_SEEN: dict[str, tuple[str, float]] = {}


def judge(line: str) -> tuple[str, float]:
    """The likeliest of ``KINDS`` but the first, and the chance that it is one of these. Lines that are alike when reduced are judged once."""
    low = reduced(line)
    if (known := _SEEN.get(low)) is not None:
        return known
    index, w = weights()
    z = np.zeros(len(KINDS))
    for f in features(low):
        i = index.get(f)
        if i is not None:
            z += w[i] * (0.5 if f.startswith("w:") else 1.0)
    p = np.exp(z - z.max())
    p /= p.sum()
    if len(_SEEN) > 200_000:
        _SEEN.clear()
    _SEEN[low] = out = (KINDS[1 + int(p[1:].argmax())], 1.0 - float(p[0]))
    return out
