"""Lines written by hand, after the tagger's first table and by the same author; mentions stand in double brackets behind a letter for their kind:
n name, e email, p phone, i identity_number, a street_address. Mistakes on the lines of even number were read while the tagger was made;
of those of odd number only the totals were seen, but often, and its settings were chosen by them too: neither half is untouched."""

LINES = r"""
Sorry for the late answer, I was on holiday with [[n:Emily Watson]] and her kids.
mobrien: forwarding this to [[e:mobrien@acme-corp.com]] because the pager never rang.
If anything burns, the duty phone is [[p:+1-212-555-0187]].
[[n:Wei Zhang]] rewrote the tokenizer over the weekend and it is twice as fast.
The original paper is by [[n:Thomas Müller]] and [[n:Anna Schmidt]].
[[n:Linus Torvalds]] would not like this commit message.
Could somebody from payroll confirm that [[n:David Brown]] still works here?
- [[n:Michael O'Brien]], platform engineering
Hi, I'm [[n:Sarah Connor]], the new maintainer of the installer.
Visual Studio refuses to attach to the process since Friday.
please write to [[e:jane dot doe at example dot com]] and not to the list
My landlord's place, [[a:221B Baker Street, London]], has terrible wifi.
The courier wants a second address: [[a:1600 Pennsylvania Ave NW, Washington, DC 20500]].
Wire the deposit, then ring [[p:(415) 555-2671]] and ask for billing.
We got a fax from [[p:+49 89 636 48018]] this morning.
Her social security number is [[i:078-05-1120]], which is famously fake.
The clerk typed [[i:QQ 12 34 56 C]] into the national insurance field and it passed.
DNI [[i:12345678Z]] has the right check letter.
my passport ([[i:C01X00T47]]) expired in March
I think [[n:Grace Hopper]] said it first.
The talk by [[n:Ada Lovelace]] starts at 14:30 in room 3.
Mail from [[n:Svetlana Kuznetsova]] arrived at 09:12.
[[n:Müller, Jörg]] was listed twice in the export.
[[n:J. Fernández]] and [[n:M. Rossi]] share one desk.
Yesterday evening [[n:Priyanka Chopra]] told us the room was booked.
We thank [[n:Tim Berners-Lee]] for the invention.
The reviewer, [[n:Ngozi Okonjo]], asked for more tests.
Has [[n:Pieter van den Berg]] answered your question yet?
[[n:Maria da Silva]] cannot log in with her new badge.
Nobody told [[n:Kim Min-seo]] that the freeze had started.
cc [[n:Oleg Tinkov]], since he owns the billing code
Invoice 2291 goes to [[n:Hannah Arendt]], [[a:12 Kings Road, Brighton]].
You will find [[n:Noam Levi]] on the fourth floor.
Agenda: 1) budget 2) [[n:Francesca Moretti]] on hiring 3) lunch
[[n:Jean-Luc Picard]] <[[e:picard@starfleet.example.org]]>
Patch from [[n:Rasmus Lerdorf]] <[[e:rasmus@php.example]]> applied.
Thanks to everyone who came, and to [[n:Kofi Annan]] most of all.
Don't forget that [[n:Bjarne Stroustrup]] reads this list.
The plaintiff, [[n:Erin Brockovich]], asks for damages.
That decision was taken by [[n:Angela Merkel]] in 2011.
Support escalated it to [[n:Rajesh Kumar]] at once.
Sent from my phone - [[n:Aisha Bello]]
[[n:Tomáš Dvořák]] approved the change.
on tuesday i had coffee with [[n:Carlos Mendes]] and we sketched the api
The lab book of [[n:Marie Curie]] is still radioactive.
A. Turing wrote the manual.
I pinged Sarah, she is out until noon.
Thanks Bob!
Ask @jenkins-bot to rebuild it.
ping @octocat and @hubot
I use Google Chrome on Windows Server.
The Eiffel Tower is taller than that.
Pull Request Template is missing from the Getting Started page.
Red Hat and Oracle both ship this driver.
We fly to San Francisco for the offsite.
Internet Explorer is finally dead.
Apache Kafka lags behind by 40000 messages.
The Test Runner hangs when the Garbage Collector kicks in.
Click File Menu, then Recent Projects.
Known Limitations
Table of Contents
Continuous Integration
Dark Theme looks odd on Firefox Nightly.
Spring Framework 5 dropped that interface.
Big Endian machines fail here.
git@github.com:torvalds/linux.git
git clone ssh://git@bitbucket.example.com:7999/core/engine.git
npm i left-pad@1.3.0 @types/node@20.1.0
pushed to origin from deploy@web01:/srv/app
@Autowired private final Clock clock;
commit 9fceb02d0ae598e95dc970b74767f19372d61af8
Segfault at 0x00007ffde3b1a2c0 ip 0000000000401136
started at 1700000000, finished at 1700003600
2024-02-29T23:59:59.999Z WARN clock skew 1500 ms
10.0.0.254:5432 refused the connection
Error 500-113-2040 from the gateway
build 20240131.4 took 12m 30s
request 8f14e45f-ceea-467f-a0e6-2b1c3d4e5f60 was dropped
We saw 415 failures in 2671 runs.
version 4.15.0-112 of the kernel
SKU 555-0199-22 is out of stock
There are 12 Main branches and 3 Side branches.
offset 636480180 in a file of 78051120 bytes
RFC 2119 and RFC 8174 define the keywords.
ISBN 978-3-16-148410-0
phone home is disabled by default
The address bar flickers when I type.
name resolution takes 30 seconds
an email address is required
Set id=88213377 and try again.
UPDATE jobs SET state = 'done' WHERE id = 5550187;
Mean 12.5, median 11, max 1999.
The name field accepts 64 characters.
Passport is the auth library that we use.
Street View imagery is blurred.
Drive letters above F: fail.
At least one of the two must be set.
dot products are slow on this GPU
Look at the dot in the path.
Our API lives at api dot internal, no mail there.
Three of us met at the office at 9.
The court ruled on Monday.
Square brackets are not escaped.
Lane changes are detected late.
Reach the doctor under [[p:030 4505 50]] or [[p:+49 30 450 550 11]].
(old number [[p:0171 5550199]], new one [[p:0151 23456789]])
Appelez le [[p:01 42 68 53 00]] avant midi.
Standard: [[p:+33 1 42 68 53 00]]
Llámame al [[p:+34 612 345 678]] cuando puedas.
Il cellulare è [[p:+39 347 123 4567]].
Whatsapp: [[p:+55 11 91234-5678]]
from abroad dial [[p:+44 20 7946 0958]], inside the UK [[p:020 7946 0958]]
my mobile, [[p:07700 900461]], is off during the flight
Dispatch, [[p:+61 2 9374 4000]], open all day
[[p:555-867-5309]] is a song
[[p:650.253.0000]] rings but nobody answers
"[[p:+81 3-6384-9000]]" is stored with a blank
Dial [[p:1-800-356-9377]] for flowers.
The bot texted [[p:+919876543210]] eleven times.
Numbers to test with: [[p:+48 22 123 45 67]], [[p:+46 8 123 456 78]], [[p:+31 20 123 4567]]
{"tel": "[[p:+1 646-555-0134]]", "verified": false}
Zadzwoń: [[p:601 234 567]]
TEL;TYPE=cell:[[p:+4791234567]]
Reception [[p:(02) 9374 4001]] ext 12
he keeps calling from [[p:(212) 736-5000]]
Contact via [[p:+27 82 123 4567]] or [[p:+254 712 345 678]].
Bereitschaft: [[p:0721/6083000]]
call me maybe: [[p:415-555-2671]]
Notruf der Hausverwaltung [[p:0800 1234567]]
My number changed to [[p:+7 (921) 123-45-67]].
the form says [[p:(020) 7946 0123]] is too long
Numéro du support : [[p:+32 2 123 45 67]]
[[p:+1 (604) 555-0112]]
Ph [[p:+64 21 123 456]]
reach out to [[e:press@museum.example.org]] for photos
[[e:k.tanaka@lab.example.jp]] bounced
Login with [[e:Test.User+spam@Example.COM]] works, with [[e:test.user@example.com]] it does not.
From: "[[n:Zoë Kravitz]]" <[[e:zoe.k@studio.example]]>
ldap returns mail=[[e:hgranger@hogwarts.example.ac.uk]] twice
Envíe el formulario a [[e:recursos.humanos@empresa.example.es]].
Écrivez à [[e:jeanne.moreau@cinema.example.fr]] s'il vous plaît.
Schick es an [[e:poststelle@rathaus.example.de]], danke.
[[e:o'connor.tj@navy.example.mil]] is valid, believe it or not
https://shop.example.com/verify?mail=[[e:buyer42@mailbox.example]]&t=9
smtp: RCPT TO:<[[e:list-owner@groups.example.net]]>
write me: [[e:paul [at] kernel [dot] example]]
[[e:nina(at)fjord.example.no]] for questions about maps
contact is [[e:ravi AT example DOT in]]
my mail is [[e:sam_w at proton dot me]], use PGP
the alias [[e:dev-null@void.example]] swallows everything
git config user.email [[e:me@home.example]]
* [[e:anja@x.example]] - owner
* [[e:bo@y.example]] - reader
To unsubscribe send a mail to [[e:majordomo@vger.example.org]].
Address book: [[e:a.b-c_d@sub.domain.example.com]]; nothing else.
User [[e:qa+17@corp.example.io]] sees a blank page.
account=[[e:svc.reports@bank.example]] ip=10.1.1.7 result=ok
Mail schreiben an [[e:j.schulze (at) verein.example]] genügt.
She signs as [[e:dr.grey@hospital.example]].
[[i:536-90-4399]] is not a valid SSN any more
He sent me his SSN, [[i:219-09-9999]], in the chat.
ssn: [[i:457-55-5462]]
NI number [[i:AB123456C]] appears in the dump.
taxpayer identification number [[i:12-3456789]]
Meine Steueridentifikationsnummer ist [[i:86 095 742 719]].
Steuer-IdNr. [[i:65929970489]]
NIE [[i:X1234567L]] was rejected by the form.
CPF [[i:529.982.247-25]] é válido.
Mon numéro de sécu est le [[i:1 85 05 78 006 084]].
Codice fiscale: [[i:RSSMRA85T10A562S]]
personnummer [[i:811218-9876]]
PESEL [[i:44051401359]] belongs to a pensioner.
Aadhaar [[i:2345 6789 0123]] leaked through the log.
PAN card [[i:ABCPE1234F]]
passport number [[i:L898902C3]] from the specimen page
Her passport is [[i:M1234567]].
travel document [[i:PA0940443]], valid until 2029
Reisepass [[i:C4VMK6GJ2]] liegt bei
social insurance number [[i:046 454 286]]
{"national_id": "[[i:199-28-3471]]"}
the tax office sent a letter about tax number [[i:93815/08152]]
the unmasked identity number [[i:850505-1234]] is in the csv
BSN [[i:123456782]]
His national id [[i:784-1984-1234567-1]] is printed on the badge.
ID card number [[i:AZ1234567]] ends up in the trace.
mask_ssn("[[i:212-34-5678]]") should give stars
Found a passport no. [[i:E12345678]] in the fixtures, please purge.
tax id [[i:123-45-6789]] and [[i:987-65-4320]] collide
the applicant's NINO is [[i:JG103759A]]
My office is at [[a:350 Fifth Avenue, New York]].
Lives at [[a:10 Downing Street]].
Please deliver to [[a:4 Privet Drive, Little Whinging]].
The depot at [[a:742 Evergreen Terrace]] closes at six.
Billing: [[a:1 Infinite Loop, Cupertino, CA 95014]]
Besuchen Sie uns: [[a:Unter den Linden 77, 10117 Berlin]]
Lieferung an [[a:Hauptstraße 5]], Hinterhaus
Die Wohnung in der [[a:Sonnenallee 120a, 12045 Berlin]] ist frei.
Rendez-vous au [[a:36 quai des Orfèvres, 75001 Paris]].
notre siège, [[a:12 rue de la Paix]], est fermé
Vive en [[a:Calle de Alcalá 45, 28014 Madrid]].
sede legale: [[a:Via Roma 12, 20121 Milano]]
Ons kantoor: [[a:Prinsengracht 263, 1016 GV Amsterdam]]
kontor på [[a:Drottninggatan 71, 111 36 Stockholm]]
Biuro: [[a:ul. Marszałkowska 84, 00-514 Warszawa]]
return label: [[n:Nadia Petrov]], [[a:88 Colin P Kelly Jr St, San Francisco, CA 94107]]
the server room moved to [[a:2300 Oracle Way, Austin]]
[[a:15 Yemen Road]], Yemen
[[a:17 Cherry Tree Lane]]
geocode("[[a:1060 West Addison Street, Chicago]]") gives null
Parcel for [[a:Flughafenstraße 3, 22335 Hamburg]] is stuck.
I grew up on [[a:9 Elm Court, Apt 2B]], by the river.
Morada: [[a:Rua Augusta 24, 1100-053 Lisboa]]
Adres: [[a:Damrak 1]]
shipping_address=[[a:500 Terry A Francois Blvd, San Francisco 94158]]
warehouse [[a:27 Old Gloucester Street, London WC1N 3AX]]
Please visit [[a:8 Rue de Londres, 75009 Paris]] on the 5th.
the clinic at [[a:55 Fruit Street, Boston, MA 02114]] runs an old release
[[n:Lena Horne]];[[a:104 Park Lane]];[[p:+1 312 555 0143]]
insert into clients values (7, '[[n:Omar Sharif]]', '[[e:omar@nile.example]]', '[[p:+20 2 2735 1234]]');
| [[n:Greta Garbo]] | [[p:08-123 45 67]] | stage |
name=[[n:Buster Keaton]] mail=[[e:bk@silent.example]]
Employee: [[n:Ingrid Bergman]], SSN [[i:301-22-8719]]
"[[n:Akira Kurosawa]]" matches, "Akira" alone does not
const OWNER = "[[n:Satyajit Ray]]";
Geschäftsführer: [[n:Romy Schneider]], [[n:Klaus Kinski]]
Réalisé par [[n:Agnès Varda]] et [[n:Jacques Demy]].
Escribí a [[n:Pedro Almodóvar]] la semana pasada.
Il regista [[n:Federico Fellini]] non risponde.
Mów mi [[n:Andrzej Wajda]].
С нами говорил [[n:Андрей Тарковский]].
> [[n:Ingmar Bergman]] wrote:
Signed-off-by: [[n:Dorothy Vaughan]] <[[e:dvaughan@naca.example]]>
Approved-by: [[n:Katherine Johnson]]
I agree with [[n:Mary Jackson]], merge it.
[[n:Annie J. Easley]] found the overflow.
See the mail of [[n:C. Babbage]] from last week.
Guten Tag Herr [[n:Konrad Zuse]],
"""
