"""Labelled exemplars of template residue, written from what web servers, frameworks, editors and word processors commonly say.

Each line is one exemplar. RESIDUE lines stand in place of content; TELLING lines speak about such things. They are the default of
``residue.judged``, which takes a table of others. Numbers stand for any number; a ``slot:`` word stands for any unfilled slot of that form.
"""

# Common wordings of notices, error pages, filler and slots.
RESIDUE = """
you need to enable javascript to run this app
please enable javascript to view this page
please enable javascript to continue using this application
javascript is disabled in your browser please enable it and reload the page
javascript is not available we have detected that javascript is disabled in this browser
this site requires javascript to work properly
this page needs javascript turn it on and reload to display the content
javascript must be enabled in order for you to use this site
your browser does not support javascript or it is switched off
your browser is not supported please upgrade to a newer version or use a different browser
your browser is out of date update or switch to a modern browser
scripts are disabled or blocked allow scripts for this site to continue
noscript this site is not available without scripting
scripting is turned off in your browser switch scripting on to use this page
if nothing is shown or nothing appears please allow scripts
this content cannot be displayed without javascript
checking your browser before accessing the site
this process is automatic your browser will redirect to your requested content shortly please allow up to 5 seconds
this may take a few seconds cookies and scripts are required
enable javascript and cookies to continue
just a moment please wait while we verify that you are human
cookies are blocked by your browser please accept cookies to open this site
performance and security by ray id 0
bitte aktivieren sie javascript in ihrem browser um diese seite anzuzeigen
diese seite benötigt javascript um den inhalt zu lesen
ihr browser unterstützt kein javascript
veuillez activer javascript dans votre navigateur pour afficher cette page
ce site nécessite javascript pour fonctionner
por favor active javascript en su navegador para ver esta página
habilite javascript para continuar
per favore abilita javascript nel tuo browser per visualizzare questa pagina
ative o javascript no seu navegador para ver esta página
schakel javascript in om deze pagina te bekijken
пожалуйста включите javascript в вашем браузере чтобы продолжить
для работы сайта необходим javascript
このページを表示するには javascript を有効にしてください
error 404 not found
404 not found the requested url was not found on this server
the page you requested could not be found
the page you are looking for might have been removed had its name changed or is temporarily unavailable
this page is no longer available it has been moved or deleted
return to the home page go back to the front page
sorry the page does not exist or the link is broken
403 forbidden you do not have permission to access this page on this server
access denied you are not authorized to view this page
401 unauthorized authentication is required
400 bad request the server could not understand the request
405 method not allowed
408 request timeout
410 gone
429 too many requests you have reached the rate limit please wait and retry
you have reached your hourly or daily limit of pages try again later
too many visitors or connections please slow down
500 internal server error the server encountered an error and could not complete your request
502 bad gateway the server received an invalid response
503 service unavailable the service is temporarily unavailable please try again later
504 gateway timeout the server did not respond in time
http error 0 please try again later
the requested page could not be loaded or served request id 0
the requested resource could not be served
error code 0 message internal server error id status
error code message not found
error code message service unavailable
error code message bad gateway
error code message gateway timeout
error code message forbidden
error code message too many requests
something went wrong please try again later
oops an error occurred we could not load this page
an unexpected error has occurred reference number 0
failed to load the entry content could not be loaded
the item or entry you requested could not be found
error establishing a database connection
could not connect to the database
fatal error uncaught exception thrown in file.php on line 0
warning undefined variable in file.php on line 0
traceback most recent call last
exception in thread main at java.lang
segmentation fault core dumped
upstream connect error or disconnect reset before headers reset reason connection failure
no healthy upstream
connection refused connection timed out
your session has expired please log in again to continue reading
your session timed out sign in again
you must be logged in to read this please log in or register
we are down for maintenance and will be back shortly
the site is undergoing scheduled maintenance all services will be back in a few minutes
this site can't be reached the server took too long to respond
this account has been suspended
under construction coming soon check back later
seite nicht gefunden die angeforderte seite existiert nicht mehr
fehler 404 die seite wurde nicht gefunden oder verschoben
der server ist vorübergehend nicht erreichbar bitte versuchen sie es später erneut
zugriff verweigert
page introuvable la page demandée n'existe pas ou a été déplacée
erreur 404 la page que vous cherchez est introuvable
accès refusé
le service est temporairement indisponible veuillez réessayer plus tard
página no encontrada la página solicitada no existe vuelva al inicio
error 404 la página que busca no existe
acceso denegado
el servicio no está disponible temporalmente inténtelo de nuevo más tarde
pagina non trovata la pagina richiesta non esiste
página não encontrada a página solicitada não existe
pagina niet gevonden
страница не найдена запрошенная страница не существует
ошибка 404 страница удалена или перемещена
сервер временно недоступен попробуйте позже
код ошибки 0 сервис недоступен повторите попытку позже
доступ запрещён
ページが見つかりません
lorem ipsum
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum
this is dummy text replace before publication
this is placeholder text
placeholder content goes here
sample text goes here replace this sample text
your text goes here
insert your text here
enter a description here
add content here
text to be written later
description to be added
content will be added soon
to be announced
to be determined
tbd tbd
tba tba
todo describe this
fixme
fill in this section later
click here to edit this text
this is a test this is only a test
hier steht ein blindtext
dies ist ein platzhalter text
beispieltext bitte ersetzen
ceci est un texte de remplissage
texte à remplacer
este es un texto de relleno
texto de ejemplo
это текст-заполнитель
здесь будет текст
slot:again
slot:keys
slot:curly
slot:dollar
slot:erb
slot:percent
slot:square
slot:insert
slot:goes
slot:your
slot:number
slot:hash
slot:under
slot:angle
slot:at
slot:todo
"""

TELLING = """
a guide for authors and writers on how to fill in a template
write slot:curly where the name of the reader should appear
use slot:curly to mark the place where the value goes
the placeholder slot:curly is replaced by the name
a variable such as slot:dollar stands for a value
put slot:insert in the text only as an example
never leave a placeholder or bracket empty or unfilled
for example slot:square is how a link is written
the manual explains what the error message means
he explained that the page showed an error
the word placeholder means a mark that holds a place
the sign on the door said access denied
"""
