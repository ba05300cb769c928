"""Sentences on which the residue models of ``residue`` are fitted, written for that purpose; none is taken from a corpus.

They say, in four languages, what such pages say: that a page is missing, access refused, a service down or slow, a session over, a visitor limited or
to be verified; that scripts, cookies or another browser are needed; that a text is yet to be written. HELD_OUT has pages in other words,
on which the threshold was set; nothing is fitted on them."""

from __future__ import annotations

# Reason phrases of HTTP, the classical filler passages, and the sentences the models are fitted on.
REASONS = """
400 Bad Request. 401 Unauthorized. 403 Forbidden. 404 Not Found. 405 Method Not Allowed. 408 Request Timeout. 410 Gone. 413 Content Too Large. 414 URI Too Long. 429 Too Many Requests. 500 Internal Server Error. 501 Not Implemented. 502 Bad Gateway. 503 Service Unavailable. 504 Gateway Timeout. HTTP Error 404. HTTP Status 500. Error 403. Error code: 503. Status: 502.
"""
FILLER = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam, eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo. Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt. Neque porro quisquam est, qui dolorem ipsum quia dolor sit amet.
At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti quos dolores et quas molestias excepturi sint. Nam libero tempore, cum soluta nobis est eligendi optio cumque nihil impedit quo minus id quod maxime placeat facere possimus. Vivamus sagittis lacus vel augue laoreet rutrum faucibus. Praesent commodo cursus magna, vel scelerisque nisl consectetur et. Donec ullamcorper nulla non metus auctor fringilla. Aenean lacinia bibendum nulla sed consectetur. Cras mattis purus sit amet fermentum. Maecenas faucibus mollis interdum. Nullam quis risus eget urna mollis ornare vel eu leo. Curabitur blandit tempus porttitor. Vestibulum id ligula porta felis euismod semper. Etiam porta sem malesuada magna mollis euismod. Integer posuere erat a ante venenatis dapibus posuere velit aliquet.
Your heading goes here. Put your headline, your title and your name here. Enter a headline here. Testing: test 0, test 0 0 0, test, test. Add your own text in this box. Write something about yourself. Click here to edit this text. Insert your content in this block. Dummy copy for layout only. This sentence is a stand-in until the final copy arrives. Placeholder paragraph: swap it for real words. Body copy to come. Section left empty for now. Add a short description. Type your summary in this field. Example heading, example subheading, example paragraph. Filler filler filler. More filler content below. Text to be supplied by the author. Content will be added soon. Under construction. Nothing here yet. Draft text, to be replaced before publication. TBD. TODO: write this section. XXX XXX XXX. aaa bbb ccc ddd. test test test testing one two three. foo bar baz qux. blah blah blah. asdf asdf jkl jkl. qwerty qwerty uiop. hello world hello world.
Hier kommt Ihr Text hin. Hier steht bald Ihr Text, hier steht später mehr. Ihre Überschrift hier eintragen. Das ist nur ein Blindtext und hat keine Bedeutung. Bitte tragen Sie hier Ihren eigenen Inhalt ein. Platzhalter für die Überschrift. Musterüberschrift, Musterabsatz. Der endgültige Text wird nachgereicht. Dieser Absatz ist ein Platzhalter. Inhalt wird noch ergänzt. Noch kein Text vorhanden. Beispieltext zum Ausfüllen der Seite. Beschreibung wird später eingefügt. Diese Seite befindet sich im Aufbau. Entwurf, bitte überschreiben.
Votre texte apparaîtra à cet endroit. Mettez votre titre, votre nom et votre texte ici même. Ceci est un faux texte sans signification. Saisissez ici votre propre contenu. Titre d'exemple, paragraphe d'exemple. Le texte définitif sera fourni plus tard. Ce paragraphe sert à remplir la page. Contenu à compléter. Aucun texte pour le moment. Page en construction. Description à rédiger. Texte de remplissage. Ébauche à remplacer avant publication.
Escriba aquí su propio texto. Ponga su título, su nombre y su texto aquí mismo. Contenido pendiente de revisión, texto pendiente de entrega. Sustituya este texto de ejemplo por su propio texto. Este es un texto simulado sin significado. Añada su contenido en este bloque. Título de muestra, párrafo de muestra. El texto definitivo se entregará más adelante. Este párrafo solo sirve para rellenar la página. Contenido por completar. Todavía no hay texto. Página en construcción. Descripción por redactar. Texto de relleno. Borrador, reemplazar antes de publicar.
"""
ERRORS = """
Sorry, this page does not exist. We looked everywhere but could not find that page. The address may be mistyped or the link may be out of date. The document you asked for is gone. That page has been removed, renamed or moved to another place. Check the spelling of the address and try once more. Go to the home page or use the search box. Return to the front page. Nothing was found at this location. The file you requested could not be located on this host. No such page. Dead link. The resource is no longer available.
You are not allowed to see this page. Access to this resource is denied. You do not have the rights to view this directory. Permission denied by the server. Your account is not authorized for this area. This content is restricted. Please contact the administrator if you believe this is a mistake. Login required. Sign in to view this content. You must be logged in. Your login has timed out; please log in again. Session expired, reload the page and sign in. Authentication failed. Invalid or missing token. Blocked by the security policy. Your request was rejected by the firewall. This address has been blocked because of unusual traffic. Please complete the check to prove that you are human. Verifying your connection, this may take a few seconds. Slow down: you have sent too many requests in a short time. Requests from your address are limited for now. Your network has been limited. Rate limit exceeded, wait a moment and retry after 00 seconds. Quota exceeded for this client.
An unexpected error occurred while handling your request. The server ran into a problem and was unable to complete what you asked for. Something broke on our end; our team has been told. Please try again in a few minutes. We apologise for the inconvenience. The service is down for maintenance and will be back shortly. The site is temporarily offline. This service is overloaded at the moment. The upstream server did not answer in time. The connection to the server was reset. Unable to connect to the server. The page could not be loaded. No response from the backend. The proxy received an invalid response. Error establishing a database connection. Unhandled exception in application. Stack trace omitted. Fatal error while rendering this page. Request failed with status code 000. Reference number 0000000. Incident id 00ab00cd. Error id: 0000. Correlation id. Timestamp. Host error. Your browser is working. The origin server is not reachable. DNS lookup failed. Certificate not trusted. Connection timed out. Connection refused.
Diese Seite gibt es leider nicht. Wir konnten die gewünschte Seite nicht finden. Die Adresse ist falsch geschrieben oder der Link ist veraltet. Die Seite wurde gelöscht, umbenannt oder verschoben. Bitte prüfen Sie die Adresse. Zur Startseite wechseln oder die Suche benutzen. Kein Zugriff auf diese Seite. Ihnen fehlt die Berechtigung für diesen Bereich. Der Zugriff auf diese Ressource ist nicht erlaubt. Bitte wenden Sie sich an den Administrator. Anmeldung erforderlich. Ihre Anmeldung ist abgelaufen, bitte loggen Sie sich wieder ein. Sitzung beendet. Es ist ein unerwarteter Fehler aufgetreten. Der Server konnte Ihre Anfrage nicht bearbeiten. Etwas ist schiefgelaufen. Wegen Wartungsarbeiten ist diese Seite vorübergehend nicht erreichbar. Der Dienst steht momentan nicht zur Verfügung. Versuchen Sie es später wieder. Wir bitten um Entschuldigung. Zeitüberschreitung bei der Verbindung. Zu viele Anfragen, bitte warten Sie einen Augenblick. Ungültige Anfrage. Verbindung fehlgeschlagen. Fehlercode 000. Fehlernummer. Vorgangsnummer 0000.
Désolé, cette page n'existe pas. Nous n'avons pas trouvé la page que vous cherchez. L'adresse est mal saisie ou le lien n'est plus valable. Cette page a été supprimée, renommée ou déplacée. Vérifiez l'adresse saisie. Revenir à la page d'accueil ou lancer une recherche. L'accès à cette page est interdit. Vous n'avez pas les droits nécessaires pour consulter cette ressource. Accès non autorisé. Contactez l'administrateur du site. Connexion requise. Votre connexion a pris fin, identifiez-vous de nouveau. Session terminée. Une erreur inattendue s'est produite. Le serveur n'a pas pu traiter votre demande. Un problème est survenu de notre côté. Le site est en maintenance et sera bientôt de retour. Service temporairement hors ligne. Le site est momentanément inaccessible, revenez dans 0 minutes. Veuillez essayer plus tard. Veuillez nous excuser pour la gêne occasionnée. Délai de connexion dépassé. Trop de requêtes, patientez un instant. Requête invalide. Échec de la connexion. Code d'erreur 000. Numéro d'incident 0000.
Lo sentimos, esta página no existe. No hemos podido encontrar la página que busca. La dirección está mal escrita o el enlace ha caducado. La página fue eliminada, renombrada o movida. Revise la dirección. Vaya a la página principal o use el buscador. El acceso a esta página está prohibido. No dispone de los derechos necesarios para ver este recurso. Acceso no autorizado. Póngase en contacto con el administrador. Debe identificarse. Su conexión ha terminado, identifíquese de nuevo. Sesión finalizada. Se ha producido un error inesperado. El servidor no pudo atender su solicitud. Algo ha fallado por nuestra parte. El sitio está en mantenimiento y volverá pronto. Servicio fuera de línea por ahora. Pruebe más tarde. Disculpe las molestias. Tiempo de conexión agotado. Demasiadas peticiones, espere un momento. Solicitud no válida. Fallo de conexión. Código de error 000. Número de incidencia 0000.
"""
SCRIPTS = """
This site needs JavaScript to work properly. This application requires JavaScript and requires cookies. It looks like JavaScript is switched off. Turn on JavaScript in the settings of your browser and reload the page. Without scripts this page stays empty. We are sorry, but the viewer does not function unless JavaScript is allowed. Scripting seems to be blocked by an extension; please allow it for this site. Your browser is out of date and cannot show this page. A modern browser with JavaScript is required. Enable cookies and reload. Cookies are turned off; this page requires cookies. Disable the ad blocker or add this site to the list of exceptions. noscript: the application cannot start. Loading, please wait. The application is loading. Redirecting, click here if nothing happens.
Für diese Seite muss JavaScript eingeschaltet sein. JavaScript ist offenbar ausgeschaltet. Schalten Sie JavaScript in den Einstellungen Ihres Browsers ein und laden Sie die Seite neu. Ohne Skripte bleibt diese Seite leer. Ihr Browser ist veraltet. Erlauben Sie Cookies und Skripte für diese Seite. Schalten Sie den Werbeblocker aus. Die Anwendung wird geladen, bitte warten. Diese Webseite funktioniert nur mit JavaScript.
Ce site a besoin de JavaScript pour fonctionner. JavaScript semble désactivé. Autorisez JavaScript dans les réglages de votre navigateur puis rechargez la page. Sans scripts, cette page reste vide. Votre navigateur est trop ancien. Acceptez les cookies et les scripts pour ce site. Désactivez le bloqueur de publicités. L'application est en cours de chargement, veuillez patienter.
Este sitio necesita JavaScript para funcionar. Parece que JavaScript está desactivado. Permita JavaScript en los ajustes de su navegador y vuelva a cargar la página. Sin scripts esta página queda vacía. Su navegador es demasiado antiguo. Acepte las cookies y los scripts de este sitio. Desactive el bloqueador de anuncios. La aplicación se está cargando, espere por favor.
"""

# Ordinary prose, so that common words of the four languages count as prose in a small corpus too.
PROSE = """
The office moved to the new building in the spring, and most of the furniture came along. People who work in the early shift share their desks with the late one, so everything has to be cleared away by noon. We asked around whether the arrangement suits them; nearly all said that it does, although some would like more quiet. A list of open points hangs beside the door and is read out every Friday. When a point has been there for longer than a month, somebody is named who takes care of it. The numbers for the year were better than we had expected, mainly because fewer parts had to be sent back. Before that, each delivery was counted twice, once at the gate and once in the hall, which took the whole morning. Now the driver signs a sheet, and what is missing gets noted on it. If you are new here, read the notes of the last three meetings first, then talk to your neighbours, and only after that change anything. Most machines run through the night; they stop when their tray is empty or when the temperature rises above forty degrees. It took a while until the reason was understood: the filter had been installed the wrong way round. Since then the values have stayed in the usual range, and the alarm has not been heard again.
Im Frühjahr zog das Büro in das neue Gebäude, und die meisten Möbel kamen mit. Wer in der Frühschicht arbeitet, teilt sich den Tisch mit der Spätschicht, deshalb muss bis zum Mittag alles weggeräumt sein. Wir haben gefragt, ob die Regelung allen passt; fast alle sagten ja, nur einige wünschten sich mehr Ruhe. Neben der Tür hängt eine Liste der offenen Punkte, die jeden Freitag vorgelesen wird. Steht ein Punkt länger als einen Monat darauf, wird jemand bestimmt, der sich darum kümmert. Die Zahlen des Jahres waren besser als erwartet, vor allem weil weniger Teile zurückgeschickt werden mussten. Früher wurde jede Lieferung zweimal gezählt, einmal am Tor und einmal in der Halle, was den ganzen Vormittag dauerte. Die meisten Maschinen laufen die Nacht durch; sie halten an, wenn das Fach leer ist oder die Temperatur über vierzig Grad steigt. Es dauerte eine Weile, bis der Grund verstanden war: Der Filter war falsch herum eingebaut. Seitdem liegen die Werte wieder im üblichen Bereich, und der Alarm wurde nicht mehr gehört.
Au printemps, le bureau a déménagé dans le nouveau bâtiment et la plupart des meubles ont suivi. Ceux qui travaillent le matin partagent leur table avec l'équipe du soir, il faut donc tout ranger avant midi. Nous avons demandé si cette organisation convenait à tous ; presque tout le monde a répondu oui, même si certains voudraient plus de calme. Une liste des points ouverts est affichée près de la porte et lue chaque vendredi. Quand un point y reste plus d'un mois, quelqu'un est désigné pour s'en occuper. Les chiffres de l'année ont été meilleurs que prévu, surtout parce que moins de pièces ont dû être renvoyées. Auparavant, chaque livraison était comptée deux fois, une fois à l'entrée et une fois dans la salle, ce qui prenait toute la matinée. La plupart des machines tournent pendant la nuit ; elles s'arrêtent lorsque le bac est vide ou que la température dépasse quarante degrés. Il a fallu du temps pour comprendre la raison : le filtre avait été monté à l'envers. Depuis, les valeurs sont restées dans la plage habituelle.
En primavera la oficina se trasladó al edificio nuevo y casi todos los muebles fueron con ella. Quienes trabajan por la mañana comparten la mesa con el turno de tarde, de modo que hay que recogerlo todo antes del mediodía. Preguntamos si el arreglo les convenía; casi todos dijeron que sí, aunque algunos querrían más silencio. Junto a la puerta cuelga una lista de los puntos abiertos que se lee cada viernes. Cuando un punto lleva más de un mes, se nombra a alguien que se ocupe de él. Las cifras del año fueron mejores de lo que se esperaba, sobre todo porque hubo que devolver menos piezas. Antes cada entrega se contaba dos veces, una en la entrada y otra en la nave, lo que ocupaba toda la mañana. La mayoría de las máquinas funcionan durante la noche; se paran cuando la bandeja está vacía o la temperatura pasa de cuarenta grados. Se tardó un tiempo en entender la causa: el filtro estaba montado al revés. Desde entonces los valores se mantienen en el margen habitual.
"""

#: Pages that nothing is fitted on, and ordinary texts of the kind that could be taken for them.
HELD_OUT_RESIDUE = """
Oops! We can't find that page any more. Try searching or return home.
The link you followed seems to be broken. Please check the address or go back.
This page is missing. It may have been moved or deleted by its owner.
Access to this page has been denied because we believe you are using automation tools.
You need permission to open this item. Ask the owner for access or switch to another account.
You have been signed out. Sign in again to continue.
We'll be right back. The site is undergoing scheduled maintenance.
Service is temporarily unavailable. Please try again later.
Server error. We are working to fix the problem, please come back soon.
The server took too long to answer your request.
Too many attempts. Please wait a minute before trying again.
Internal error, request id 8842-11. If the problem persists contact support.
Die Seite, die Sie suchen, ist nicht mehr vorhanden. Zurück zur Übersicht.
Sie haben keine Berechtigung, um auf diese Seite zuzugreifen.
Der Server ist überlastet. Bitte versuchen Sie es in einigen Minuten erneut.
Ihre Sitzung ist abgelaufen, bitte melden Sie sich neu an.
La page que vous avez demandée est introuvable ou a changé d'adresse.
Vous n'êtes pas autorisé à accéder à cette page.
Le service est indisponible pour cause de maintenance, merci de réessayer plus tard.
La página solicitada no se encuentra disponible o ha cambiado de dirección.
No tiene autorización para acceder a esta página.
El servidor no responde, inténtelo otra vez en unos minutos.
You must enable JavaScript in order to use this website.
JavaScript has been disabled in your browser. Please activate it to see the content.
Bitte JavaScript im Browser einschalten, um den Inhalt zu sehen.
Vous devez autoriser JavaScript pour utiliser ce site.
Para usar esta web debe permitir JavaScript en su navegador.
Lorem ipsum dolor sit amet, sed diam nonumy eirmod tempor invidunt ut labore et dolore magna aliquyam erat.
Add your text here. This paragraph is only a placeholder and will be replaced.
Dies ist ein Platzhalter, der Text folgt später.
Ce texte est provisoire et sera remplacé.
Este texto es provisional y será reemplazado.
"""
HELD_OUT_PROSE = """
On Tuesday the mail relay lost its route to the archive for eleven minutes, and the queue grew to four thousand messages before the operators moved it to the second host.
The new model was trained on ninety days of messages. It knows 214 message ids, of which thirty were seen in fewer than five intervals.
Users of the portal reported that old bookmarks led to an error page after the migration; the redirects were added the same evening and the reports stopped.
Before the restart, check that no import is running, save the state of the queue and write the time into the shift book.
The team reviewed how the gateway handles requests that time out. Retries doubled the load during the outage, so the limit was lowered from five to two.
The scheduler writes one line per job. Jobs that fail three times in a row are listed in the morning digest together with their owner.
Am Montag fiel der Speicher im zweiten Rechenzentrum aus. Die Ursache war ein defektes Netzteil, das am Abend ersetzt wurde.
Wer die Schwellen ändert, trägt den alten und den neuen Wert in das Protokoll ein und vergleicht die Zahl der Alarme nach einer Woche.
Lundi matin, le relais a perdu la connexion à l'archive pendant onze minutes. Les opérateurs ont déplacé la file vers le second serveur.
Le modèle a été entraîné sur quatre-vingt-dix jours de messages et connaît deux cents identifiants.
El lunes el almacén perdió la conexión con el archivo durante once minutos y los operadores movieron la cola al segundo servidor.
Antes de reiniciar, compruebe que no hay ninguna importación en marcha y anote la hora en el libro de turno.
Access reviews take place every quarter. Each owner confirms which accounts may read the ledger, and accounts nobody confirms are closed after two weeks.
The page on disk quotas explains how to read the weekly report, where the limits come from and whom to ask for more room.
Our scripts run every ten minutes on the build host. The browser tests were moved to the night because they need the staging database.
"""
