"""The labelled table of the personal-information tagger, made by rule from public knowledge.

Mentions are filled from common given and family names of many countries, from family names put together from syllables and
the endings that family names have, and from the formats in which countries write telephone numbers, identity numbers and
addresses. The lines around them are letters, forms, trailers, records and log lines as they are found anywhere, in several languages;
lines without a mention are made of the same words, and of what only looks alike (versions, hashes, times, products, places).
Names, number formats, words and lines were written for this table. Some kinds of lines were added after looking at what was missed or
found too much on sf0.1 (a verb before a name, counters and offsets in logs, commit hashes, quantities in several languages), so
the table isn't blind to that data. Of 729 lines, six have a longest literal part that also stands in sf0.1: two git trailers and four
common beginnings of sentences.
"""

from __future__ import annotations

import random
import re

#: Given names that are common somewhere.
GIVEN = """
James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Susan Thomas Sarah Daniel Karen Emily Kevin Laura Brian George Anna Peter Paul Mark Helen Simon Alice Oliver Sophie Jack Chloe
Hans Klaus Jürgen Wolfgang Ursula Monika Sabine Katrin Lukas Felix Pierre Jean Claude Marie Céline Amélie Luc Benoît Chantal José María Carlos Lucía Javier Pilar Miguel Ángel Giovanni Giulia Marco Chiara Francesca Matteo
João Beatriz Tiago Inês Rui Pieter Willem Anke Sanne Joost Piotr Agnieszka Krzysztof Małgorzata Tomasz Zofia Lars Astrid Björn Sven Maja Mikko Aino Jukka Søren Mette Knut Sigrid Ivan Olga Sergei Natalia Dmitry Svetlana Алексей Ольга Иван
Mehmet Ayşe Emre Zeynep Ahmed Fatima Omar Layla Yusuf Amina Hassan Noor Ali Reza Shirin David Noa Avi Wei Li Xiu Jing Ming Hiroshi Yuki Kenji Sakura Min-jun Ji-woo Seo-yeon Raj Priya Anil Deepika Arjun Sunita Kofi Ama Chidi Ngozi Thabo Zanele
Linh Nguyen Minh Siti Budi Dewi Juan Camila Mateo Valentina Diego Sofía Luiz Ana Rafael Stefan Elena Bogdan Ioana Nikos Eleni Giorgos Jana Petr Zuzana László Katalin Ivana Marko Siobhán Declan Rhys
""".split()

#: Family names that are common somewhere.
FAMILY = """
Smith Johnson Williams Brown Jones Miller Davis Wilson Taylor Anderson Thomas Moore Martin Thompson White Clark Lewis Walker Hall Young King Wright Hill Scott Green Baker Carter Turner Parker Evans Murphy Kelly Byrne Ryan Campbell Stewart Reid Hughes
Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Dubois Durand Leroy Moreau Laurent Lefèvre Roux Girard García Rodríguez Martínez López Sánchez Pérez Gómez Fernández Torres Ramírez Rossi Russo Ferrari Bianchi
Romano Colombo Ricci Marino Silva Santos Ferreira Pereira Oliveira Costa Almeida Jansen Bakker Visser Smit Meijer Nowak Kowalski Wiśniewska Wójcik Lewandowski Zieliński Andersson Karlsson Nilsson Eriksson Hansen Olsen Larsen Nielsen Korhonen Virtanen Mäkinen
Ivanov Petrova Smirnov Kuznetsova Popov Иванов Петрова Shevchenko Bondarenko Yılmaz Kaya Demir Haddad Khalil Mansour Rahman Khan Hussain Hosseini Cohen Levi Wang Zhang Chen Liu Huang Zhao Wu Tanaka Suzuki Takahashi Watanabe Kim Park Choi Singh Sharma Patel Gupta
Iyer Mensah Okafor Adeyemi Nkosi Dlamini Tran Pham Wijaya Santoso Mendoza Castro Rojas Popescu Ionescu Papadopoulos Novák Svoboda Horváth Nagy Horvat Petrović
""".split()

#: Endings of family names, and words that stand before them.
ENDINGS = "son sen sson mann berg burg stein bach feld thal ström gren quist lund holm vik dal ton ley ford well wood worth field land ham man er ini etti elli one ano ucci ez es eira inho oux ault ard eau ski ska cki wicz czyk enko chuk ov ova ev in ina ić vić ák ová escu eanu oglu yan ian dze shvili idis akis moto mura saki uchi ng wala".split()
PARTICLES = "van|van der|van den|de|de la|del|della|di|da|dos|von|von der|zu|ter|ten|el|al|bin|ben|le|la|Mac|Mc|O'|D'|St.".split("|")
ONSETS, VOWELS, CODAS = "b br c ch d dr f fl g gr h j k kl kr l m n p pr qu r s sch sk sl st t th tr v w z".split() + [""], "a e i o u a e i o ä ö ü é ei au oo ie".split(), "l ll n nn r rr s ss t tt k ck m nd lt rn x".split() + [""]

#: How telephone numbers are written; # is a digit, ^ a digit but 0.
PHONES = """
+1 ^## ### ####|+1 (^##) ###-####|+1-^##-###-####|+1.^##.###.####|+1^#########|(^##) ###-####|(^##) ###-####|^##-###-####|^##-###-####|^##.###.####|1-^##-###-####|1 (^##) ###-####|^## ### ####
+44 20 #### ####|+44 (0)20 #### ####|020 #### ####|020 #### ####|0### ### ####|+44 7### ######|+447#########|07### ######|07### ### ###|0## #### ####|+44 (0)#### ######|(0####) ######
+49 ## ########|+49 (0)## ########|+49 ### ####-##|+49 ## #####-###|+49 1## #######|0800 #######|0800 ### ####|0### #######|0## ########|0##/#######|0##/########|0### / ### ## ##|0###-#######|+43 1 ### ## ##|+41 ## ### ## ##|0## ### ## ##
+33 ^ ## ## ## ##|+33^########|0^ ## ## ## ##|0^ ## ## ## ##|0^ ## ## ## ##|0^ ## ## ## ##|0^.##.##.##.##|+32 ### ## ## ##|+34 ### ### ###|+34 ### ## ## ##|^## ## ## ##|+39 0# #### ####|+39 3## #######|+351 ### ### ###|+31 6 ########|+31 (0)20 ### ####|06-########|020-#######
+48 ### ### ###|+48 ## ### ## ##|+46 8 ### ### ##|+46 7#-### ## ##|+47 ## ## ## ##|+45 ## ## ## ##|+358 40 ### ####|+7 (9##) ###-##-##|+7 9## ### ## ##|8 (9##) ###-##-##|+380 ## ### ## ##|+90 5## ### ## ##|+30 21# ### ####|+420 ### ### ###
+61 ^ #### ####|(0^) #### ####|0^ #### ####|04## ### ###|+614########|+61 4## ### ###|+61^########|+64 21 ### ####|+81 3-####-####|+81 90 #### ####|03-####-####|090-####-####|+82 10-####-####|010-####-####|+86 1## #### ####|+86 10 #### ####|1##-####-####
+91 ##### #####|+91-##########|0## ########|+55 11 9####-####|(11) 9####-####|+52 55 #### ####|+54 9 11 ####-####|+56 9 #### ####|+27 8# ### ####|08# ### ####|+234 80# ### ####|+254 7## ### ###|+971 50 ### ####|+972 5#-###-####|+65 #### ####|+852 #### ####|+353 1 ### ####|+353 8# ### ####|00## ### ######
""".strip().replace("\n", "|").split("|")

#: How countries write identity, tax, social security and passport numbers; @ is a capital letter.
NUMBERS = """
###-##-####|###-##-####|###-##-####|^##-##-####|### ## ####|^## ## ####|^## ## ####|##-#######|@@######@|@@######@|@@ ## ## ## @|@@ ## ## ## @|@@######@|########@|########-@|########-@|@#######@|@-#######-@|##.###.###-@
## ### ### ###|## ### ### ###|## ### ### ###|###########|###########|0##########|###########|##/###/#####|#####/#####|###/####/####|^ ## ## ## ### ### ##|^ ## ## ## ### ###|@@@@@@##@##@###@|######-####|######-####|########-####|######+####|###.###.###-##|##.###.###/####-##|##.###.###-#|########-#
#### #### ####|@@@@@####@|### ### ###|### ### ##|#########|######-#######|##################|#### #### #|##-######-#-##|######/####|###-###-###|### ###-##-##|@#########|@########|@@#######|@@#######|@@#######|@#######|##@@#####|@@ #######|@@@######|#########|@########|@######@#|@##@##@##|@#@@@##@#|@@####@@#|@########
# ## ## ## ### ###|^ ## ## ## ### ### ##|@@ ######|####-#######-#|###-####-#######-#|##.##.##-###.##
""".strip().replace("\n", "|").split("|")

#: Words of addresses.
ROADS = "Street St. St Road Rd Rd. Avenue Ave Ave. Lane Ln Drive Dr Court Ct Boulevard Blvd Terrace Place Way Close Crescent Square Highway Parkway Row Hill".split()
OF_ROADS = "Maple Oak Elm Cedar Pine Church High Station Park Mill School Victoria Queen King London Lake River Spring Washington Lincoln Main Market Bridge Chestnut Sunset North Second Third Fifth 42nd 5th".split()
TOWNS = "London Berlin Paris Madrid Roma Lisboa Amsterdam Warszawa Stockholm Dublin Chicago Boston Austin Denver Springfield Portland Toronto Sydney Auckland München Hamburg Lyon Milano Sevilla Porto Utrecht Kraków Wien Zürich Leeds Bristol Seattle".split()
HOSTS = "example.com example.org example.net mail.example.com gmail.com outlook.com yahoo.co.uk gmx.de proton.me web.de orange.fr libero.it mail.ru corp.example.net uni.example.edu acme.example acme-corp.com lists.example.org".split()
TOP = "com org net io de fr nl co.uk eu dev edu ch example test invalid".split()

#: Words of any text about software.
THINGS = "file server queue cache buffer parser config build test log report backup request response token user account session job pipeline worker thread table index column schema query driver image page button form link list page invoice order customer ticket issue branch commit release version module package plugin library script command shell screen network proxy socket port disk memory cluster node container service endpoint header field value key record row batch stream event message timeout retry error warning crash exception lock handle path folder directory patch review merge deployment migration template dashboard".split()
DOING = "fix open close read write load parse check update restart move copy delete rename merge revert deploy test debug review skip ignore call send fetch store flush rebuild install remove run".split()
LIKE = "new old broken empty slow wrong stale missing local remote public private large small last first second same other nightly internal external default custom".split()
PRODUCTS = """
Visual Studio|Visual Studio Code|Internet Explorer|Google Chrome|Google Cloud|Microsoft Edge|Microsoft Teams|Windows Server|Mac Mini|Mission Control|Red Hat|Stack Overflow|Docker Desktop|Docker Compose|Apache Kafka|Apache Spark|Apache Arrow|Amazon Web Services|Android Studio|Ubuntu Server|Linux Mint|Raspberry Pi|Spring Boot|Ruby On Rails|Open Source|Azure Pipelines
New York|San Francisco|Los Angeles|Hong Kong|United States|United Kingdom|South Africa|Rio Tinto|Lorem Ipsum|Hello World|Pull Request|Code Review|Release Notes|Known Issues|Getting Started|Table Of Contents|Steps To Reproduce|Expected Behavior|Actual Result|Best Practices|Quick Start|Change Log|Feature Request|Bug Report|Merge Conflict
Unit Test|Test Suite|Stack Trace|Null Pointer|Access Denied|Permission Denied|Not Found|Bad Gateway|Internal Server Error|Segmentation Fault|Data Center|Machine Learning|Monte Carlo|Black Friday|Good Morning|Best Regards|Kind Regards|Happy New Year|Site Reliability|Customer Support|Human Resources|Power Shell|Git Hub|Type Script|Hash Map|Content Type|User Agent|Max Retries|Dark Mode
""".strip().replace("\n", "|").split("|")
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January March April June July August October November".split()

#: Words with which sentences begin, and nouns that have a capital in the midst of them.
STARTS = "If When Why How Both Since After Before While The This That There Then Maybe Some Any No Not Only With Without From For In At It We You I A An As Can Could Should Does Is Are Kann Können Wenn Weil Meiner Seit Nach Bei Ich Wir Das Der Die Ein Warum Wie Si Quand Pourquoi Dans Avec Depuis Le La Les Un Une Est-ce Je Nous Cuando Por Como Con Desde El Los Una Puede Se Quando Perché Dopo Il Lo Gli Può Non Quando Como Com Depois O Os Uma Pode Não Als Kan Waarom Sinds Met Het De Een Ik Wij Er Czy Jak Kiedy Po Od Nie To Gdy Если Когда Почему После Не Мы Как På När Varför Efter Det Vi".split()
NOMEN = "Meinung Fehler Datei Dateien Verzeichnis Einträge Zeile Zeilen Spalte Tabelle Version Zeit Sekunden Speicher Platte Rechner Netz Schlüssel Wert Werte Knoten Prozess Ausgabe Eingabe Meldung Warnung Protokoll Einstellungen Änderung Änderungen Umgebung Benutzer Rechte Anfrage Antwort Verbindung Sitzung Prüfung Ergebnis Daten Beispiel Hinweis Update Server Test Tests Problem Lösung Frage Idee".split()

#: Small words by language.
SMALL_WORDS = [line.split() for line in (
    "the a an to of in on at by for with from and or but not is was are be has had will can it he she they we you this that there when then so if as into after before about said asked told once twice week again",
    "der die das ein eine zu von in auf an bei für mit aus und oder aber nicht ist war sind hat hatte wird kann es er sie wir ihr dies wenn dann so als nach vor über sagte fragte gestern heute",
    "le la les un une à de du dans sur chez pour avec par et ou mais pas est était sont a avait sera peut il elle nous vous ce quand alors si comme après avant hier demain semaine",
    "el la los un una a de en con por para y o pero no es era son ha fue puede él ella nosotros esto cuando entonces si como después antes ayer hoy semana pasada escribí dijo",
    "il lo la i un una a di in con per da e o ma non è era sono ha può lui lei noi questo quando allora se come dopo prima ieri oggi detto risponde",
    "o a os um uma de em com por para e ou mas não é era são tem pode ele ela nós isto quando então se como depois antes ontem hoje disse",
    "de het een van in op aan bij voor met uit en of maar niet is was zijn heeft kan hij zij wij dit als dan zo na voor gisteren vandaag zei",
    "w na do z od po dla przez i lub ale nie jest był są ma może on ona my to kiedy więc jak przed wczoraj dziś powiedział mi mów",
    "в на к с от по для и или но не есть был это он она мы когда тогда если как после перед вчера сегодня сказал говорил",
    "en ett i på av till från med för och eller men inte är var har kan han hon vi detta när så om efter före igår sade",
)]

#: Lines that hold mentions. {thing}, {do}, {like} and so on are filled with words; the rest are mentions.
FOUND = """
-- ¦{name}¦{name}¦{name}¦{name}¦{name}¦{name} {start} {thing}¦{name} did it {when}.¦{name} sees the same with {product}.¦{name} likes the {like} {thing}.¦{name}: {start} not.¦{name}: I {do} it {when}.¦It is {name}.¦Then {name} left.¦for {name}¦to {name}¦by {name}¦with {name}, {name} and {name}¦{name}¦{name}¦{name}¦{name}¦{name}¦{name}¦{address}¦{phone}¦{email}¦- {name}¦-- {name}¦{name}, {town}¦{name} ({thing} team)¦{name} <{email}>¦{name}, {email}¦{name} | {email} | {phone}
Hi {name},¦Hi, I'm {name}.¦Hi, my name is {name} and I {do} the {thing}.¦Dear {name},¦Hello {name}, thanks for the {thing}.¦Dear Ms. {name},¦Dear Dr. {name}, the {thing} is {like}.¦Best, {name}¦Cheers, {name}¦Regards, {name}¦Thanks, {name}¦Thanks to {name} for the {like} {thing}.
{Verb} {name}.¦{Verb} {name} about the {thing}.¦{Verb} {name} or {name} {when}.¦{Verb} {name} (she knows the {thing}).¦Then {verb} {name}.¦Please {verb} {name} before you {do} it.¦{name}: done¦{name}: {code} is {like}¦The {thing} for {name} went to {address} {when}.¦{code} prints {id} {when}.¦{code} prints {phone} {when}.¦It shows {id} to everyone.¦It shows {phone} to everyone.¦{id}¦I spoke with {name} about the {thing}.¦We asked {name} to {do} it {day}.¦Could {name} or {name} {do} the {thing}?¦Can you loop in {name}, please?¦It was {name} who found the {like} {thing}.¦According to {name} the {thing} is {like}.¦As {name} pointed out, {class} is {like}.
{name} reported that the {like} {thing} does not {do}.¦{name} says the {thing} was {like} {when}.¦{name} is going to {do} {code} next week.¦{name} and {name} will {do} the {thing}.¦{name}, can you {do} the {thing}?¦{name} (she/her) wrote the {thing}.¦{name} from {town} sent a {thing}.¦{name} wrote:¦{name} writes:¦{name} commented {when}:
On {day}, {name} wrote:¦on {nth} {day}, {name} wrote:¦> On {nth} {day} {year}, {name} said:¦{day} {nth}, {name}:¦On {date} at {time}, {name} wrote:¦As {name} wrote {when}, {do} it.¦{start} {name} said so.¦{start} {name} and {name} know.¦{Gerund} {name} fails.¦{Gerund} {address} fails {when}.¦{Gerund} {address} gives the {like} {thing}.¦{Gerund} {phone} fails {when}.¦{Gerund} {email} fails.¦{Gerund} {id} fails {when}.¦{Gerund} {address} into {small} {thing}s¦{start} {address}¦On {date} {name} wrote:¦On {day}, {date}, {name} <{email}> wrote:¦> {name} wrote:¦Quoting {name}:¦From: {name} <{email}>¦To: {name} <{email}>, {name} <{email}>¦Cc: {name} <{email}>¦Reply-To: {email}¦Sender: {email}
Signed-off-by: {name} <{email}>¦Co-authored-by: {name} <{email}>¦Reviewed-by: {name} <{email}>¦Acked-by: {name}¦Reported-by: {name}¦Tested-by: {name} <{email}>¦Author: {name} <{email}>¦Author: {name}¦Committer: {name} <{email}>¦@author {name}¦# Copyright (c) {year} {name}¦// TODO({name}): {do} {code}
Maintainer: {name} <{email}>¦Assignee: {name}¦Reporter: {name}¦Reviewer: {name}¦Owner: {name}¦Contact: {name}, {phone}¦Contact person: {name}¦Full name: {name}¦name={name}¦name={name} mail={email}¦user={name} phone={phone}¦name={name} id={id}¦{name} / {email}¦{name} - {phone}¦git config user.email {email}¦git config user.name "{name}"¦const OWNER = "{name}";¦AUTHOR = '{name}'¦tel={phone} name={name}¦ssn:{id}¦id_no={id}¦Name: {name}¦Customer: {name}¦Patient: {name}¦Attn: {name}¦Employee {name} has the {like} {thing}.
The account belongs to {name}.¦The {thing} was signed by {name}.¦My colleague {name} will {do} it.¦Our customer {name} called {when}.¦My manager, {name}, wants to {do} the {thing}.¦I'm writing on behalf of {name}, who cannot {do} the {thing}.¦Ticket opened by {name} for {name}.¦Invoice to {name}, {address}¦Deliver to {name}, {address}, {phone}
Email me at {email}.¦Mail {email} if you need the {thing}.¦Write to {email} or {email}.¦Please send the {thing} to {email}.¦my address is {email}¦Reach us at {email} or {phone}.¦contact: {email}¦e-mail: {email}¦Email: {email}¦mailto:{email}¦<{email}>¦({email})¦Ping {email} {when}.¦User {email} gets {error}.¦{email} cannot {do} the {thing}.¦{email}
{email}, {email}¦The {thing} for {email} is {like}.¦login={email} status={small}¦user={email} ip={ip} took {small}ms¦[{time}] INFO mail sent to {email} from {ip}¦{time} WARN bounced recipient={email} code={small}¦to="{email}" subject="{like} {thing}"¦https://{host}/unsubscribe?email={email}&id={small}¦https://{host}/login?user={email}¦{code} returned {email} instead of the {thing}.¦Whoever reads {email} should {do} the {thing}.¦you can get me under {email}
Call {phone}.¦Call me at {phone} {when}.¦You can call {name} on {phone}.¦My number is {phone}.¦Phone: {phone}¦phone {phone}¦Tel. {phone}¦Tel.: {phone}¦tel: {phone}¦Mobile: {phone}¦Fax: {phone}¦Cell: {phone}¦T {phone} / M {phone}¦WhatsApp {phone}¦Text me: {phone}¦Hotline {phone}, ask for {name}.¦Support is at {phone}.¦We dialled {phone} and nobody answered.¦SMS to {phone} failed {when}.¦The number {phone} is {like}.¦{phone} or {phone}¦{phone} and {phone} give the {like} {thing}.¦{phone}¦- {phone}¦formats {phone} as {phone}¦The {thing} rejects {phone} as a number.¦phone={phone}
SSN: {id}¦SSN {id}¦ssn={id}¦Social security number: {id}¦My social security number is {id}.¦his SSN ({id}) is in the {thing}¦national insurance number {id}¦NI number: {id}¦NINO {id}¦Tax ID: {id}¦tax id {id}¦tax_id={id}¦Steuer-ID: {id}¦Steuernummer {id}¦DNI {id}¦DNI: {id}¦NIE {id}¦CPF: {id}¦passport {id}¦Passport No: {id}¦passport number {id} was {like}¦My passport is {id}, issued {year}.¦national ID {id}¦ID card {id}¦identity number: {id}¦personnummer {id}¦PESEL {id}¦BSN {id}¦Aadhaar {id}¦PAN {id}¦numéro de sécurité sociale : {id}¦codice fiscale {id}¦Personal number: {id}
The citizen with identity number {id} is {like}.¦Validation of tax number {id} fails with {error}.¦The {thing} shows the passport number ({id}) in clear text.¦We must not log {id}, it is a social security number.¦The form accepts {id} as national id.¦"{id}" is not accepted as a tax number.¦The tax number of {name} is {id}.¦{name}, born {date}, passport {id}¦{id} ({name})¦{code} prints {id} unmasked.¦mask('{id}')¦the value {id} is a real person's id number
Send it to {address}.¦Ship to: {address}¦Address: {address}¦address={address}¦My address is {address}.¦Our office is at {address}.¦I live at {address}.¦We moved to {address} {when}.¦The parcel went to {address}.¦The {thing} cannot find {address}.¦Billing address: {address}¦Visit us: {address}¦{address}¦{address}¦{name}, {address}¦{name}; {address}; {phone}¦HQ, {address}¦Located at {address}.¦The geocoder puts {address} in {town}.¦Pick up the {thing} at {address}, second floor.¦deliver to {address} before {day}¦The meeting is at {address}.¦"{address}" splits into two rows.
{name},{email},{phone}¦{name};{phone};{address}¦{name}\t{email}¦{small},{name},{id},{address}¦"{name}","{email}","{phone}"¦INSERT INTO users VALUES ({small}, '{name}', '{email}');¦INSERT INTO contacts (name, phone) VALUES ('{name}', '{phone}');¦UPDATE users SET phone = '{phone}' WHERE name = '{name}';¦SELECT * FROM users WHERE email = '{email}';¦('{name}', '{id}', '{address}', '{phone}')¦{"name": "{name}", "email": "{email}"}¦{"fullName": "{name}", "ssn": "{id}"}¦{"phone": "{phone}", "id": {small}}¦{"address": "{address}", "zip": null}¦name: {name}¦name={name}¦name={name} mail={email}¦user={name} phone={phone}¦name={name} id={id}¦{name} / {email}¦{name} - {phone}¦git config user.email {email}¦git config user.name "{name}"¦const OWNER = "{name}";¦AUTHOR = '{name}'¦tel={phone} name={name}¦ssn:{id}¦id_no={id}¦owner: "{name}"¦email: "{email}"¦<name>{name}</name>¦<phone>{phone}</phone>¦| {name} | {phone} | {thing} |¦| {name} | {email} |¦assert find("{name}") is None¦person = Person("{name}", "{email}", "{phone}")¦expected "{name}" but got "{like}"
Mit freundlichen Grüßen, {name}¦Viele Grüße {name}¦Sehr geehrte Frau {name},¦Sehr geehrter Herr {name},¦Guten Tag Frau {name},¦Madame {name},¦Señor {name}:¦Gentile signor {name},¦Geachte heer {name},¦Szanowna Pani {name},¦Die Nummer von {name} ist {phone}.¦Die Zentrale: {phone}¦Adresse: {address}¦Anschrift {address}¦Besuchen Sie uns in der {address}.¦Dirección: {address}¦Indirizzo: {address}¦Adres: {address}¦Adresse : {address}¦Numéro : {phone}¦Numer telefonu: {phone}¦Mon numéro de sécurité sociale est le {id}.¦Appelez le {phone} avant midi.¦Tél. {phone}¦Tél : {phone}, fax : {phone}¦au {phone}¦Rappelez {name} au {phone}.¦Ruf bitte {phone} an.¦{nomen}: {phone}¦{nomen} der {nomen} {phone}¦Die {nomen} ist unter {phone} erreichbar.¦Notfall {phone}¦Teléfono: {phone}¦Telefono {phone}¦Telefoon: {phone}¦Telefon: {phone}¦Telefone: {phone}¦Тел. {phone}¦Steueridentifikationsnummer {id}¦Meine Steueridentifikationsnummer ist {id}.¦Sozialversicherungsnummer: {id}¦Ausweisnummer {id}¦Personalausweis {id}¦Identifikationsnummer {id}¦numéro de passeport {id}¦numéro de sécu {id}¦numéro fiscal : {id}¦número de pasaporte {id}¦número de identidad: {id}¦NIF {id}¦número de contribuinte {id}¦numero di passaporto {id}¦codice fiscale di {name}: {id}¦burgerservicenummer {id}¦paspoortnummer {id}¦numer PESEL {id}¦numer paszportu {id}¦personnummer: {id}¦ИНН {id}¦паспорт {id}¦Geschäftsführer: {name}, {name}¦Directeur : {name}¦Gérant {name}¦CEO {name}¦CTO: {name}¦President {name}¦Réalisé par {name} et {name}.¦Escribí a {name} la semana pasada.¦El director {name} no responde.¦Il direttore {name} non risponde.¦Mów do {name}.¦Kierownik {name} wyjechał.¦С нами говорил {name}.¦De directeur {name} is ziek.¦{name} at once¦It went to {name} at once.¦Ask {name} at {time}.¦We met {name} at {address}.¦{name} at the {thing} desk¦The talk by {name} starts at {time}.¦a book by {name}¦The paper of {name} and {name} says so.¦{start} {name} at {time}, {start} {thing}.¦{day} evening {name} came.¦last week {name} left¦{name} told us so.¦{name} found it.¦{name} found the {like} {thing}.¦{name} approved the {thing}.¦not even {name} knows¦Nobody told {name} {when}.¦user.email {email}¦git config user.email {email}¦email {email}¦{like} {thing} {email}¦Ich habe mit {name} gesprochen.¦Bitte melden Sie sich bei {name} unter {phone}.¦Meine Adresse ist {address}.¦Anrufen unter {phone}, Mail an {email}.¦Laut {name} ist das {thing} kaputt.¦Meine Steuernummer lautet {id}.¦Bonjour {name},¦Cordialement, {name}¦J'ai parlé avec {name} hier.¦Vous pouvez me joindre au {phone} ou à {email}.¦Mon adresse est {address}.¦Selon {name}, le serveur ne répond plus.¦Le numéro {phone} ne répond pas.¦Estimado {name}:¦Un saludo, {name}¦He hablado con {name} sobre esto.¦Mi teléfono es {phone} y mi correo {email}.¦Vivo en {address}.¦Mi DNI es {id}.¦El cliente {name} no puede entrar.¦Caro {name},¦Cordiali saluti, {name}¦Ho parlato con {name} ieri.¦Il mio numero è {phone}.¦Scrivetemi a {email}.¦Abito in {address}.¦Olá {name},¦Falei com {name} ontem.¦Meu telefone é {phone}.¦O meu e-mail é {email}, obrigado.¦Beste {name},¦Groeten, {name}¦Bel me op {phone} of mail {email}.¦Volgens {name} werkt het niet.¦Pozdrawiam, {name}¦Proszę dzwonić pod numer {phone}.¦Mój adres to {email}.¦Rozmawiałem z {name} wczoraj.¦Hälsningar, {name}¦Ring {phone} eller mejla {email}.¦Мой телефон {phone}, почта {email}.¦Пишите на {email}.¦С уважением, {name}¦По словам {name}, всё работает.¦電話は {phone} です。¦メールは {email} までお願いします。¦{name} さんに確認しました。¦请联系 {email} 或拨打 {phone}。¦{name} 已经确认了。
""".strip().replace("\n", "¦").split("¦")

#: Lines without.
CLEAN = """
The {like} {thing} does not {do} {when}.¦Why does {class} {do} the {thing}?¦We {do} the {thing} and then {do} {code}.¦Can we {do} the {like} {thing} before the {thing}?¦I tried to {do} it {when} but got {error}.¦Please {do} the {thing} first.¦It works with {version} but not with {version}.¦After the update to {version} the {thing} is {like}.¦{class} throws {error} {when}.¦{class} and {class} share a {thing}.¦Running {product} {version} on {product}.¦{product} is {like} {when}.¦{product} and {product} both {do} the {thing}.¦We use {product} in {town}.¦Our {product} {thing} runs in {town}.¦The {town} {thing} is {like}.¦We fly to {city} {when}.¦The office in {city} is closed.¦Moved from {city} to {city}.¦Big {thing}s are {like}.¦{Do} {Thing} is {like}.¦{Like} {Thing} fails.¦{Like} {Thing}s are {like} here.¦{product} dropped the {thing}.¦build {dots} took {small}m {small}s¦{small}h {small}m {small}s elapsed¦SKU {small}-{small}-{small} is out of stock¦model {small}-{small}¦The {Thing} {Thing} hangs when the {Like} {Thing} is {like}.¦See {product} for the {thing}.¦I opened {product} and the {thing} was {like}.
{start} {class} is {like}.¦{start} {class} {do} it.¦{start} {class} {start} {thing}.¦{start} {title} {when}.¦{start} {nomen} nach.¦{start} {nomen} ist {nomen}.¦Die {nomen} und der {nomen} fehlen.¦{nomen} {nomen}¦{start} ich die {nomen} prüfe, kommt {error}.¦{Gerund} {class} {when}.¦{Gerund} {title} fails.¦{Gerund} {long} {unit}s takes {small} ms.¦checked out git@{host}:{handle}/{thing}.git at {hash}¦{path} at {hash}¦{thing}.git at {version}¦{handle}/{thing} at {hash} is {like}¦{start} it is midnight UTC. {start} it stops.¦{title}¦## {title}¦### {title}¦**{title}**¦{title}:¦{title} - {title}¦1. {title}¦- [ ] {title}¦The {title} page is {like}.¦The {title} and the {title} {do} the {thing}.¦Open the {title}, then the {title}.¦{title} {version}¦{title} fails {when}.¦Moved the {title} into {class}.¦{title} Settings¦The {title} team will {do} it {day}.¦Since {day} the {title} is {like}.¦On {day} we {do} the {title}.¦On {day} the {thing} was {like}.¦{day} Morning¦Last {day} the {like} {thing} broke.
Thanks {given}!¦Thanks, {given}¦Hi {given},¦@{handle} can you {do} this?¦cc @{handle} @{handle}¦@{handle} wrote:¦Ping @{handle}, the {thing} is {like}.¦{given} will {do} the {thing}.¦assigned to @{handle}¦by {handle} in #{small}¦{handle} pushed {small} commits¦Merged by {handle}¦LGTM, {given}.¦ask {given} {when}¦user {handle} logged in from {ip}
git clone git@{host}:{handle}/{thing}.git¦git@{host}:{handle}/{handle}.git¦ssh://git@{host}/{thing}.git¦scp {thing}.txt {handle}@{ip}:/tmp¦{handle}@{thing}:~$ ls¦root@{thing}:/# {do}¦npm install {thing}@{version}¦{thing}@{version}¦@{handle}/{thing}@{version}¦@Override¦@{thing}.setter¦pip install {thing}=={version}¦https://{host}/{handle}/{thing}/issues/{small}¦https://{host}/{path}?page={small}¦look at {class} dot {do}¦at {class}.{snake}({class}.java:{small})¦  File "{path}", line {small}, in {snake}¦{error} at {path}:{small}¦meet at the {thing} at {small}¦the {thing} stopped at line {small} of {path}
commit {hash}¦{verb} it to {hash}, {start} {code} is {like}.¦traced to {hash}¦{do} {hash} first¦since {hash}, {code} fails¦{start} {hash} the {thing} is {like}.¦{hash} {like} {thing}¦{hash}¦({hash})¦the {thing} at {hash} is {like}¦bisected: {hash} is the first {like} one¦It came with {hash}, where {code} was added.¦since {hash} the {thing} is {like}¦Going back to {hash} helps.¦{thing} {long}¦{Thing} {long} is {like}¦the {thing} starts at {unit} {long}¦up to {unit} {long}¦{unit} {long} of {long}¦it points to {unit} {long}.¦jumps from {hexa} to {unit} {long}¦{unit}={long}¦{long} {unit}s¦{code} returns {long}.¦{code} returns {small} {when}.¦got {long} instead of {long}¦{error} in {CLASS}. A {like} {thing} is enough.¦We get {error}. A {like} {thing} helps.¦It fails with {ERROR}. I {do} it.¦{error}. It is {like}.¦took {small} MS IN {CLASS}. Then it stops.¦fixed in {hash}¦Reverts {hash}.¦sha256:{hash}¦checksum {hash} does not match {hash}¦UUID {uuid}¦request id {uuid}¦trace={hash} span={hash16}¦{date}¦{date} {time} INFO {thing} started¦{date}T{time}Z {class} {error}¦[{date} {time}] {thing}: {small}¦{time} DEBUG {snake} took {small} ms¦ts={long} level=warn msg="{like} {thing}"¦timestamp {long}¦epoch {long} is in the future¦build {long} failed¦Build #{long} of {product}¦job {long} was {like}¦request {long} timed out¦ticket {small}-{small}-{small}¦order no. {long}¦The offset {hexa} is {like}.¦offset {long} length {small}¦offset={long}¦pid {small} port {small}¦0x{hash16}¦{hexa}¦address {hexa}¦version {version}¦{version}¦v{version} ({date})¦{version} -> {version}¦{ip}¦{ip}:{small}¦ping {ip} took {small}.{small} ms¦port {small} on {ip} is closed¦{small} of {small} passed¦{small}%¦{small} ms¦{small} MB of {small} MB¦takes {small} seconds on {small} nodes¦between {small} and {small}¦from {small} to {small}¦size {long} bytes¦{long} rows in {small}.{small} s¦limit is {long}¦id={long}¦row id {long}¦span {dots} closed¦counter {dots}¦at {dots} the {thing} is {like}¦error {small}-{small}¦{thing}-{small}-{small}¦part number {small}-{small}-{small}¦{small} {small} {small}¦[{small}, {small}, {small}]¦matrix {small}x{small}¦PR {small}, issue {small}¦HTTP {small}¦{small} Threads¦{small} Workers are {like}¦{small} Main threads¦{small} North nodes¦Page {small} of {small}¦Chapter {small}: {title}¦Step {small}: {do} the {thing}¦Level {small} Support¦Line {small} in {path}¦Error {small} in {title}
{code} is {like}.¦{code} calls {code} {when}.¦def {snake}({thing}, {thing}):¦class {class}({class}):¦import {thing}.{thing}¦const {thing} = new {class}();¦return {class}.{snake}({thing})¦if ({thing} == null) {do}();¦{"{thing}": {small}, "{thing}": "{like}"}¦{thing}: {like}¦{thing}={small}¦--{thing}={path}¦$ {do} --{thing} {path}¦SELECT {thing} FROM {thing} WHERE id = {small};¦INSERT INTO {thing} VALUES ({small}, '{like}', '{title}');¦| {thing} | {like} | {small} |¦<{thing}>{like}</{thing}>¦> the {like} {thing}¦> {class} is {like} {when}¦* {do} {path}¦{path}¦{path}:{small}¦see {path} and {path}¦TODO: {do} {code}¦FIXME {when}
THE {THING} IS {LIKE} AND WE {DO} THE {THING}¦URGENT: {DO} THE {LIKE} {THING}¦NOTHING {DO}S THE {THING} ON A {LIKE} {THING}¦{THING} {THING} {LIKE}¦WARNING {THING} {LIKE}¦ERROR {ERROR}¦README¦LICENSE¦TODO¦NOTE: THE {THING}¦NO {THING} NO {THING}¦IMPORTANT {TITLE}¦{TITLE}¦WE {DO} THE {LIKE} {THING} WHEN THE {THING} IS {LIKE}.¦PLEASE {DO} {CLASS}
Der {thing} ist seit gestern kaputt.¦{product} braucht ungefähr {small}s.¦Es gibt mehr als {small} Einträge.¦Il y a plus de {small} fichiers.¦Cela prend environ {small}s.¦Hay más de {small} archivos abiertos.¦Tarda unos {small}s.¦Há mais de {small} ficheiros abertos.¦Demora cerca de {small}s.¦Ci sono più di {small} file aperti.¦Impiega circa {small}s.¦Er zijn meer dan {small} regels.¦Het duurt ongeveer {small}s.¦Jest więcej niż {small} plików.¦Trwa to około {small}s.¦Больше {small} файлов.¦Занимает около {small}s.¦{small} entries, {small}s¦Die neue Version {version} braucht {small} Sekunden.¦Wenn ich {product} starte, kommt {error}.¦Das {title} Fenster bleibt leer.¦Könnt ihr das bitte prüfen?¦Nach dem Update auf {version} läuft {class} nicht mehr.¦Ab {small} Einträgen wird die Liste langsam.¦Vielen Dank für die Hilfe!¦Ich sehe {error} im Protokoll.¦Le fichier {path} est vide.¦Depuis la version {version}, {product} ne marche plus.¦La page {title} affiche {error}.¦Merci pour votre aide.¦Il faut {small} secondes pour lire {path}.¦Quand je lance {product}, rien ne se passe.¦El archivo {path} no existe.¦Desde la versión {version} no funciona {product}.¦La lista tiene {small} elementos.¦Gracias por la ayuda.¦Al abrir {product} aparece {error}.¦Il file {path} non si apre.¦Con la versione {version} tutto funziona.¦Grazie mille.¦Ci sono {small} errori in {class}.¦O arquivo {path} está vazio.¦Com {product} {version} não funciona.¦Obrigado pela ajuda.¦Het bestand {path} is leeg.¦Met {product} {version} werkt het niet.¦Er zijn {small} fouten in {class}.¦Bedankt voor de hulp.¦Plik {path} jest pusty.¦Po aktualizacji do {version} {product} nie działa.¦Dziękuję za pomoc.¦Файл {path} пустой.¦После обновления до {version} {product} не работает.¦Спасибо за помощь.¦Есть {small} ошибок в {class}.¦ファイル {path} が開けません。¦{product} を {version} に更新しました。¦文件 {path} 打不开。¦升级到 {version} 以后 {product} 不能用了。¦Filen {path} är tom.
""".strip().replace("\n", "¦").split("¦")


class Filler:
    """Fills slots by rule from a seeded source of chance."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(str(self.r.randrange(10)) for _ in range(n))

    def pattern(self, pattern: str) -> str:
        c = self.r.choice
        return re.sub("[#^@]", lambda m: c("123456789") if m[0] == "^" else c("0123456789") if m[0] == "#" else c("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), pattern)

    def syllables(self, n: int) -> str:
        c = self.r.choice
        return "".join(c(ONSETS) + c(VOWELS) + c(CODAS) for _ in range(n))

    def surname(self) -> str:
        c, r = self.r.choice, self.r
        one = c(FAMILY) if r.random() < 0.35 else (self.syllables(1) + c(ENDINGS) if r.random() < 0.7 else self.syllables(2)).capitalize()
        roll = r.random()
        if roll < 0.14:
            p = c(PARTICLES)
            one = p + ("" if p in ("Mac", "Mc", "O'", "D'") else " ") + one
        elif roll < 0.22:
            one += "-" + (c(FAMILY) if r.random() < 0.5 else self.syllables(2).capitalize())
        return one.replace("'", "’") if r.random() < 0.2 else one

    def given(self) -> str:
        c, r = self.r.choice, self.r
        one = c(GIVEN) if r.random() < 0.7 else (self.syllables(1) + c(("a", "o", "e", "i", "an", "ra", "na", "us", "el", "in", "ah", "or"))).capitalize()
        return one + "-" + c(GIVEN) if r.random() < 0.03 else one

    def name(self) -> str:
        given, last, roll, c = self.given(), self.surname(), self.r.random(), self.r.choice
        initial = c("ABCDEFGHIJKLMNOPRSTVWZ") + "."
        if roll < 0.16:
            out = f"{last}, {given}" + (f" {initial}" if self.r.random() < 0.15 else "")
        elif roll < 0.26:
            out = f"{initial} {last}"
        elif roll < 0.29:
            out = f"{initial} {initial} {last}" if self.r.random() < 0.5 else f"{last}, {initial}"
        elif roll < 0.4:
            out = f"{given} {initial} {last}"
        elif roll < 0.44:
            out = f"{given} {self.given()} {last}"
        elif roll < 0.46:
            out = f"{given} {last} {c(FAMILY)}"
        else:
            out = f"{given} {last}"
        return out.upper() if self.r.random() < 0.08 else f"{given} {last.upper()}" if self.r.random() < 0.02 else out

    def host(self) -> str:
        c = self.r.choice
        word = self.syllables(2).lower() if self.r.random() < 0.6 else c(THINGS)
        return c(HOSTS) if self.r.random() < 0.4 else c(("", "", "", "mail.", "lists.", "dev.", "git.")) + re.sub("[^a-z]", "", word) + c(("", "", "-" + c(THINGS))) + "." + c(TOP)

    def email(self) -> str:
        c, r = self.r.choice, self.r
        first, last = (re.sub("[^a-z]", "", x.lower()) or "kim" for x in (self.given(), self.surname()))
        local = c((f"{first}.{last}", f"{first}.{last}", f"{first[0]}{last}", f"{first}{last}", f"{first}-{last}", f"{last}_{first}", f"{first}_{last}", f"{first}+{c(THINGS)}", f"{first}.{last}+{c(THINGS)}", f"{last}{self.digits(2)}", f"{first}{self.digits(4)}", f"{first[0]}.{last}", first, last, f"{c(THINGS)}s", c(("info", "support", "office", "admin", "hello", "sales"))))
        host = self.host()
        roll = r.random()
        if roll < 0.06:
            return f"{local}@{host}".upper()
        if roll < 0.1:
            return f"{local.title()}@{host.title()}"
        if roll < 0.7:
            return f"{local}@{host}"
        o, k = r.choice(("[]", "()", "{}", "<>", "  ", "  ", "  "))
        at, dot = f" {o.strip()}{c(('at', 'at', 'AT'))}{k.strip()} ", f" {o.strip()}{c(('dot', 'dot', 'DOT', 'd0t'))}{k.strip()} "
        if o == " " and r.random() < 0.15:
            return f"{local}@{host.replace('.', dot)}"
        if o != " " and r.random() < 0.35:
            at, dot = at.strip(), dot.strip()
        if r.random() < 0.12:
            return local + c(("(@)", "[@]", " @ ", "(at)")) + host
        return local.replace(".", dot if r.random() < 0.5 else ".") + at + (host if r.random() < 0.15 else host.replace(".", dot))

    def any_phone(self) -> str:
        """A number in groups that no country's list above has: a prefix, groups of two to four digits, one kind of separator."""
        r, c, d = self.r, self.r.choice, self.digits
        sep = c((" ", " ", " ", "-", ".", "-"))
        head = c((f"+{r.randrange(1, 999)}{c((sep, ' ', ''))}", f"+{r.randrange(1, 99)} (0){d(2)} ", f"0{d(c((1, 2, 3, 4)))}{c((sep, ' ', '/', '-'))}", f"({c(('0', ''))}{d(c((2, 3)))}) ", f"00{d(2)} ", ""))
        groups = [d(c((2, 2, 3, 3, 4))) for _ in range(c((2, 3, 3, 4)))]
        while sum(map(len, groups)) < (6 if head else 9):
            groups.append(d(c((2, 3, 4))))
        return head + sep.join(groups)

    def phone(self) -> str:
        if self.r.random() < 0.25:
            return self.any_phone()
        return self.pattern(self.r.choice(PHONES)) + (self.r.choice((" ext. ", " ext ", " x", " Ext. ")) + self.digits(self.r.choice((2, 3, 4))) if self.r.random() < 0.08 else "")

    def id(self) -> str:
        if self.r.random() < 0.12:  # letters and digits as passports and cards mix them
            c = self.r.choice
            return c("ABCDEFGHJKLMNPRSTVWXYZ") + "".join(c("0123456789") if self.r.random() < 0.75 else c("ABCDEFGHJKLMNPRTVWXYZ") for _ in range(c((7, 8, 8, 9)))) + self.digits(2)
        return self.pattern(self.r.choice(NUMBERS))

    def road(self) -> str:
        return self.r.choice(OF_ROADS) if self.r.random() < 0.35 else self.r.choice(FAMILY) if self.r.random() < 0.2 else self.syllables(self.r.choice((1, 2, 2))).capitalize() + self.r.choice(("", "", "ton", "field", "wood", "hill", "brook", "well", "moor", "by", "ham", "dale", "bury"))

    def town(self) -> str:
        return self.r.choice(TOWNS) if self.r.random() < 0.3 else self.syllables(self.r.choice((1, 2))).capitalize() + self.r.choice(("", "ton", "ville", "burg", "ham", "by", "ford", "stadt", "dorf", "mouth"))

    def address(self) -> str:
        c, r, d = self.r.choice, self.r, self.digits
        base, n = self.road(), str(r.randrange(1, c((99, 300, 2500, 20000)))) + c(("", "", "", "", "", "a", "B", "-" + str(r.randrange(1, 99)), "/" + str(r.randrange(1, 20))))
        roll = r.random()
        if roll < 0.5:
            out = f"{n} {c(('', '', '', '', 'North ', 'South ', 'East ', 'W. ', 'N. ', 'S ', 'Old ', 'Upper '))}{base} {c(ROADS)}" + c(("", "", "", "", " NW", " SE"))
            if r.random() < 0.2:
                out += c((", Apt ", ", Apt. ", ", Suite ", ", Unit ", ", Flat ", " #")) + str(r.randrange(1, 99)) + c(("", "A", "B"))
            tail = c((f", {self.town()}", f", {self.town()}, {c(('CA', 'NY', 'TX', 'IL', 'WA', 'OH'))} {d(5)}", f", {self.town()} {d(5)}", f", {self.town()} {self.pattern('@@# #@@')}", f", {self.town()} {d(4)}"))
        elif roll < 0.62:
            out = f"{n}{c((',', '', ' bis'))} {c(('rue', 'avenue', 'chemin', 'impasse', 'boulevard', 'place', 'allée', 'quai', 'route'))} {c(('de ', 'des ', 'du ', 'de la ', 'd’', ''))}{base}"
            tail = f", {d(5)} {self.town()}"
        elif roll < 0.78:
            kind = c(("Via", "Via", "Viale", "Piazza", "Corso", "Calle", "Calle", "Avenida", "Av.", "Paseo", "Plaza", "C/", "Carrer", "Rua", "Rua", "Travessa", "Praça", "ul.", "ulica", "al.", "ул.", "ulice"))
            out = f"{kind} {c(('', '', '', 'de ', 'del ', 'da ', 'dos '))}{base}{c((' ', ' ', ', '))}{n}"
            tail = c((f", {d(5)} {self.town()}", f", {self.town()}", f", {d(2)}-{d(3)} {self.town()}", f" {d(4)}-{d(3)} {self.town()}"))
        else:
            stem = base if r.random() < 0.8 else c(OF_ROADS)
            if r.random() < 0.1:
                return f"{c(('Am', 'An der', 'Auf dem', 'Unter den', 'Im', 'Zum', 'Alte', 'Neuer'))} {base}{c(('', 'en', 'hof', 'graben', 'tor', 'markt'))} {n}" + c(("", f", {d(5)} {self.town()}"))
            out = f"{stem}{c(('strasse', 'straße', 'str.', 'weg', 'allee', 'gasse', 'platz', 'ring', 'damm', 'straat', 'laan', 'plein', 'gracht', 'gatan', 'vägen', 'gade', 'vej', 'veien', 'katu', 'tie', ' utca', ' Straße', ' Weg'))} {n}"
            tail = c((f", {d(5)} {self.town()}", f" in {d(5)} {self.town()}", f", {self.town()}", f", {d(4)} {self.pattern('@@')} {self.town()}", f", {d(3)} {d(2)} {self.town()}"))
        return out + (tail if r.random() < 0.6 else "")

    def camel(self) -> str:
        c = self.r.choice
        return "".join(c(THINGS).capitalize() for _ in range(c((2, 2, 3)))) if self.r.random() < 0.7 else re.sub(r"\W", "", self.syllables(2)).capitalize() + c(THINGS).capitalize()

    def title(self) -> str:
        c, r = self.r.choice, self.r
        if r.random() < 0.25:
            return c(PRODUCTS)
        word = lambda: (c(THINGS) if r.random() < 0.75 else c(LIKE) if r.random() < 0.97 else self.syllables(2)).capitalize()
        return " ".join(word() for _ in range(c((2, 2, 2, 3)))) if r.random() < 0.9 else c(DOING).capitalize() + " " + word()

    def other(self, slot: str) -> str:
        c, r, d = self.r.choice, self.r, self.digits
        if slot == slot.upper():
            return self.other(slot.lower()).upper()
        if slot != slot.lower():
            return self.other(slot.lower()).capitalize()
        word = lambda: re.sub(r"\W", "", self.syllables(2)).lower()
        hexes = lambda n: "".join(c("0123456789abcdef") for _ in range(n))
        version = lambda: f"{r.randrange(30)}.{r.randrange(40)}" + c(("", f".{r.randrange(30)}", f".{r.randrange(30)}", f".{r.randrange(30)}", f".{r.randrange(30)}-rc{r.randrange(9)}", f".{r.randrange(9)}-beta.{r.randrange(9)}", f".{r.randrange(9)}+{word()[:5]}"))
        snake = lambda: "_".join(c((c(THINGS), c(DOING), word())) for _ in range(c((2, 2, 3))))
        return {
            "thing": lambda: c(THINGS) + c(("", "", "", "s")) if r.random() < 0.85 else word(), "do": lambda: c(DOING), "like": lambda: c(LIKE), "town": lambda: self.town(), "product": lambda: c((c(PRODUCTS), self.syllables(2).capitalize(), word(), c(THINGS).capitalize() + c(("Kit", "Hub", "Lab", "DB")))), "class": self.camel,
            "code": lambda: c((f"{snake()}()", f"`{snake()}`", f"`{self.camel()}.{c(DOING)}()`", f"{c(THINGS)}.{c(DOING)}()", snake())), "snake": snake, "day": lambda: c(DAYS), "year": lambda: str(r.randrange(1950, 2030)), "small": lambda: str(r.randrange(1, c((10, 100, 1000, 10000, 70000)))), "long": lambda: str(r.randrange(1, 10)) + d(c((5, 6, 7, 8, 9, 10, 12, 15))),
            "date": lambda: c((f"20{d(2)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}", f"{r.randrange(1, 29)} {c(DAYS[7:])} 20{d(2)}", f"{r.randrange(1, 29):02d}/{r.randrange(1, 13):02d}/20{d(2)}", f"{c(DAYS[7:])} {r.randrange(1, 29)}, 20{d(2)}", f"{r.randrange(1, 29)}.{r.randrange(1, 13)}.20{d(2)}")), "time": lambda: f"{r.randrange(24):02d}:{r.randrange(60):02d}" + c(("", f":{r.randrange(60):02d}", f":{r.randrange(60):02d}.{d(3)}")),
            "version": version, "hash": lambda: hexes(c((7, 8, 40, 64))), "hash16": lambda: hexes(c((8, 16))), "uuid": lambda: f"{hexes(8)}-{hexes(4)}-4{hexes(3)}-{hexes(4)}-{hexes(12)}", "hexa": lambda: "0x" + hexes(c((4, 8, 12))), "ip": lambda: ".".join(str(r.randrange(256)) for _ in range(4)), "dots": lambda: c((f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)}.{d(3)}.{d(3)}", f"{d(4)}.{d(2)}.{d(2)}")),
            "error": lambda: c((c(("E", "ENO", "SIG", "ERR")) + word()[:4].upper(), f"{self.camel()}Error", f"{self.camel()}Exception", f"error {r.randrange(600)}", f"exit code {r.randrange(256)}", f"HTTP {r.randrange(400, 599)}", f"{c('EQWX')}-{d(4)}", "a segfault", "timeout", f"errno {r.randrange(99)}", f"{c(THINGS)} {c(THINGS)}: {c(LIKE)} {c(THINGS)}")),
            "path": lambda: "/".join(c((c(THINGS), word())) for _ in range(c((1, 2, 3)))) + c((f"/{snake()}.", f"/{c(THINGS)}.")) + c(("py", "rs", "go", "ts", "java", "c", "yaml", "json", "md", "log")), "host": self.host, "handle": lambda: c((word(), f"{word()}{d(2)}", f"{word()}-{word()[:4]}", f"{c(GIVEN).lower()}{d(2)}", f"{c(THINGS)}-bot", f"{c(GIVEN)[0].lower()}{word()}")),
            "verb": lambda: c(("ask", "tell", "email", "invite", "contact", "inform", "assign", "notify", "ping", "poke", "remind", "call", "thank", "meet", "add", "message")), "nth": lambda: str(r.randrange(1, 32)), "gerund": lambda: c(("parsing", "searching", "mapping", "normalizing", "loading", "sending", "entering", "looking up", "storing", "masking", "printing", "running", "visiting", "resolving", "comparing", "calling", "importing", "converting", "validating", "formatting")), "start": lambda: c(STARTS), "nomen": lambda: c(NOMEN), "unit": lambda: c(("byte", "row", "line", "block", "event", "sequence", "frame", "tick", "page", "bit", "entry")), "given": self.given, "known": lambda: c(PRODUCTS), "city": lambda: c(("San ", "New ", "Los ", "Santa ", "St. ", "North ", "Port ", "Fort ", "Cape ", "")) + self.town(), "title": self.title, "when": lambda: c(("today", "again", "on startup", "every night", "since yesterday", "under load", "after a restart", "in production", "during the migration", "when the disk is full", "at random", "after lunch", "this week", "on my laptop", "between 9 and 5", f"on {c(DAYS)}", "behind a firewall", "twice a day", "in office hours", "without a warning")),
        }[slot]()


KINDS = {"name": "name", "email": "email", "phone": "phone", "id": "identity_number", "address": "street_address"}
SLOT = re.compile(r"(\{[A-Za-z0-9]+\})")


def _fill(fill: Filler, line: str, out: list[tuple[str, str | None]], shout: bool) -> None:
    for piece in SLOT.split(line):
        slot = piece[1:-1] if SLOT.fullmatch(piece) else ""
        if slot in KINDS:
            text, kind = getattr(fill, slot)(), KINDS[slot]
        else:
            text, kind = fill.other(slot) if slot else piece, None
        if text:
            out.append((text.upper() if shout else text, kind))


def _record(fill: Filler, out: list[tuple[str, str | None]]) -> None:
    """A line of a table: fields between separators, in any order, now and then with keys, quotes or a number before."""
    r, c = fill.r, fill.r.choice
    between = c((";", ",", ", ", "; ", "\t", " | ", " / ", " - "))
    quote = c(("", "", "", '"', "'"))
    keyed = c(("", "", "", "=", ": "))
    fields = ["name"] * (r.random() < 0.7) + [c(("email", "phone", "id", "address", "phone", "id", "thing", "small", "date", "version", "title", "long")) for _ in range(c((1, 2, 2, 3)))]
    if r.random() < 0.3:
        r.shuffle(fields)
    before, after = c((("", ""), ("", ""), ("", ""), ("(", ")"), ("| ", " |"), ("[", "]"), ("{", "}"), (f"{c(('Row', 'Line', 'Entry', 'No.', '#', 'record', ''))} {r.randrange(1, 9999)}: ", "")))
    out.append((before, None))
    for k, slot in enumerate(fields):
        key = {"name": ("name", "user", "owner", "customer"), "email": ("email", "mail", "e-mail"), "phone": ("phone", "tel", "mobile"), "id": ("ssn", "tax_id", "passport", "national_id", "id_number"), "address": ("address", "street", "addr")}.get(slot, (slot,))
        out.append(((between if k else "") + (c(key) + keyed if keyed else "") + quote, None))
        out.append((getattr(fill, slot)(), KINDS[slot]) if slot in KINDS else (fill.other(slot), None))
        out.append((quote, None))
    out.append((after, None))


def _prose(fill: Filler, out: list[tuple[str, str | None]]) -> None:
    """Words of one language in any order, with a mention or a lookalike somewhere among them: what surrounds it says little."""
    r, c = fill.r, fill.r.choice
    small = c(SMALL_WORDS)
    word = lambda: c(small) if r.random() < 0.5 else fill.other("thing") if r.random() < 0.5 else re.sub("[^a-zäöüé]", "", fill.syllables(2)) or "so"
    n, at = r.randrange(1, 10), set(r.sample(range(10), c((1, 1, 2))))
    for k in range(n):
        gap = " " if k else ""
        if k in at:
            if r.random() < 0.65:
                slot = c(("name", "name", "name", "name", "name", "name", "email", "phone", "address", "id"))
                hint = {"id": c(("SSN ", "passport ", "tax number ", "ID number ", "national id ", "identity number ")), "address": c(("", "at ", "to ")), "phone": c(("", "", "tel ", "phone ", "number "))}.get(slot, "")
                out += [(gap + hint, None), (getattr(fill, slot)(), KINDS[slot])]
            else:
                out.append((gap + fill.other(c(("class", "title", "known", "given", "version", "long", "small", "hash", "hash", "code", "path", "start", "nomen", "date", "handle", "error"))), None))
        else:
            text = word()
            out.append((gap + (text.capitalize() if not k or r.random() < 0.04 else text), None))
        if k < n - 1 and r.random() < 0.08:
            out.append((c((",", ";", ":", " -", ".")), None))
    out.append((c((".", ".", "", "!", "?", ":", ",")), None))


def _log(fill: Filler, out: list[tuple[str, str | None]]) -> None:
    """A line of keys and values as programs write them, seldom with a mention among them."""
    c = fill.r.choice
    key = lambda: c(THINGS) if fill.r.random() < 0.7 else c(("ts", "span", "id", "trace", "dur", "lvl", "seq", "off", "len", "rc", "n"))
    out.append((c(("", "", "[" + fill.other("time") + "] ", fill.other("date") + " " + fill.other("time") + " ", c(("INFO ", "WARN ", "ERROR ", "DEBUG ")))), None))
    for k in range(c((2, 3, 3, 4, 5))):
        slot = c(("email", "phone", "id", "name")) if fill.r.random() < 0.06 else c(("small", "long", "dots", "dots", "hash16", "uuid", "ip", "like", "version", "path", "time", "hexa", "handle"))
        out.append(((" " if k else "") + (slot if slot in KINDS and slot != "id" else "ssn" if slot == "id" else key()) + "=", None))
        out.append((getattr(fill, slot)(), KINDS[slot]) if slot in KINDS else (fill.other(slot), None))


def labelled(lines: int, seed: int = 7) -> list[list[tuple[str, str | None]]]:
    """`lines` texts of one to four lines or sentences each, as (text, kind or None) parts."""
    fill, out = Filler(seed), []
    for _ in range(lines):
        parts: list[tuple[str, str | None]] = []
        for k in range(fill.r.choice((1, 1, 2, 2, 3, 4))):
            if k:
                parts.append((fill.r.choice(("\n", "\n", " ", " ", " ")), None))
            if fill.r.random() < 0.06:
                parts.append((fill.r.choice(("> ", "- ", "* ", "  ", ">> ", "# ")), None))
            if (roll := fill.r.random()) < 0.2:
                at = len(parts)
                (_record if roll < 0.1 else _log if roll < 0.14 else _prose)(fill, parts)
                parts[at:] = [x for x in parts[at:] if x[0]]
                continue
            line = fill.r.choice(FOUND if fill.r.random() < 0.5 else CLEAN)
            _fill(fill, line, parts, fill.r.random() < 0.05)
        out.append(parts)
    return out
