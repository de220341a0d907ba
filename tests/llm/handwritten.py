"""Sentences written by hand, apart from what the tagger is trained on, with what is in them.

``{n:...}`` marks a name, ``{m:...}`` an e-mail, ``{t:...}`` a phone number, ``{i:...}`` an identity
number and ``{a:...}`` a street address.
"""

KINDS = {"n": "person_name", "m": "email", "t": "phone", "i": "id_number", "a": "street_address"}

SENTENCES = """
Yesterday {n:Siobhan Gallagher} rang about the refund and sounded upset.
Hi team, {n:Tobias Zimmermann} is going to join us from next week.
The parcel was handed over to {n:Oluwaseun Adeyemi} at noon.
{n:Mr. Thistlewood} has now complained twice about the heating.
Could somebody forward this to {n:Margaret O'Brien} before lunch?
{n:Robert Johnson} says the printer on the third floor is jammed again.
I sat next to {n:Michael Thompson} during the whole flight.
{n:Wang Xiaoming} will present the results on Thursday.
The winner of the raffle is {n:Nguyen Van An}, congratulations!
{n:Jürgen Müller} left his umbrella in the meeting room.
{n:Dr. Sarah Connor} examined the patient and found nothing unusual.
We regret to announce that {n:Harold Pemberton} passed away on Sunday.
Photo credit: {n:Lucinda Hargreaves}
The plaintiff, {n:Ignatius Crowe}, withdrew his complaint.
My daughter {n:Philippa Langley} starts school in autumn.
Both {n:Anil Kapadia} and {n:Teresa Whitmore} voted against the motion.
In the end {n:Ms. Okonkwo-Bell} paid for everybody.
Please welcome {n:Professor Alistair McIntyre} to the stage.
"That is not what I ordered," said {n:Gwen Radcliffe}.
The keys are with {n:Desmond Achebe} at reception.
{n:Farah Siddiqui} asked me to water her plants.
This cake was baked by {n:Rosalind Ferncombe}.
Nobody has seen {n:Patrick Dunleavy} since the party.
The tenancy agreement names {n:Callum Fraser} as guarantor.
According to {n:Yolanda Prescott}, the lift will be repaired tomorrow.
{n:Mrs Abernathy} prefers tea without milk.
Her supervisor, {n:Hiroshi Nakamura}, approved the leave.
Candidate: {n:Emeka Nwosu}. Result: passed.
I owe {n:Bridget Hanlon} twenty pounds.
When {n:Vikram Chandrasekhar} returns, tell him the server is down.
{n:Leopold Strasser} and his brother run the bakery on the corner.
Many thanks to {n:Imogen Blackwood} for the lovely flowers.
Minutes taken by {n:Solomon Adjei}.
The referee was {n:Mr Bartholomew Finch}.
Frau {n:Schmidbauer} ist heute nicht im Büro.
Gestern hat {n:Katharina Obermaier} das Paket abgeholt.
Wir gratulieren {n:Herrn Dr. Ansgar Thielemann} zum Geburtstag.
{n:Leonie Brandstätter} übernimmt ab Juli die Leitung.
Der Zeuge {n:Friedhelm Kossmann} konnte sich nicht erinnern.
Mein Kollege {n:Maximilian Huber} ist krank.
Das Foto stammt von {n:Swantje Petersen}.
Laut {n:Burkhard Reinders} kommt die Lieferung morgen.
{n:Gerlinde Aschenbrenner} bittet um Rückmeldung bis Freitag.
Die Wohnung gehört {n:Torsten Wiegand}.
Hier hat schon wieder {n:Annegret Paulsen} geparkt.
{n:Sébastien Lacroix} n'est pas venu à la réunion.
Le médecin, {n:Solange Berthier}, a signé l'ordonnance.
J'ai prêté mon vélo à {n:Maxime Delaunay}.
{n:Madame Vasseur} attend votre réponse.
Notre guide s'appelle {n:Gaëlle Kermadec}.
Le tableau appartient à {n:Aristide Fontanel}.
{n:Corentin Le Goff} remercie toute l'équipe.
Ma sœur travaille avec {n:Yasmine Benali}.
Demandez le dossier à {n:Hugues Montclair}.
La maîtresse, {n:Bérénice Caron}, est absente.
{n:Ximena Aguirre} no pudo venir a la cena.
El coche es de {n:Baltasar Ibáñez}.
La profesora {n:Remedios Castaño} corrigió los exámenes.
Me lo contó {n:Nicanor Villalobos} en la oficina.
{n:Doña Milagros Peñalver} espera en la puerta.
El testigo {n:Rodrigo Escalante} no recordaba nada.
Ayer operaron a {n:Amparo Quintana}.
Las fotos son de {n:Leandro Barrios}.
{n:Ginevra Caputo} ha perso le chiavi di casa.
Il medico {n:Ettore Bellandi} ha firmato la ricetta.
Ho incontrato {n:Ludovica Santoro} al mercato.
{n:Signora Pellegrini}, il suo pacco è pronto.
La relazione è stata scritta da {n:Fabrizio Monti}.
Mio zio {n:Raffaele D'Amico} vende biciclette.
Write to {m:gwendolyn.ashcroft@quickparcel.co.uk} if anything is missing.
my new address: {m:tz1987 at webmail dot de}
User login is {m:m_haddad@unibase.edu} since March.
Reply-to = {m:sales.lead@bakeryhouse.fr}
The newsletter is sent from {m:noreply@gardeners-weekly.org}.
Bitte antworten Sie an {m:k.obermaier@posthaus.at}, nicht an mich.
You will find me under {m:jonny_b_goode@rockmail.net}
Mon courriel : {m:s.lacroix@lyceevoltaire.fr}
Escríbeme a {m:ximena.aguirre84@correoandino.cl} cuando puedas.
La mia mail è {m:ginevra@studiocaputo.it}
Invoices go to {m:billing+2024@northwind-traders.com} only.
{m:FRONTDESK@HOTELASTORIA.COM} never answered.
I tried {m:help (at) printshop (dot) com} twice.
cc: {m:a.kapadia@citycouncil.gov.uk}, please
Send a copy of the lease to {m:callumf@tenantsunion.scot}.
Her old mailbox {m:r-ferncombe@cakes.co.nz} is full.
the mailing list is {m:parents-class4@schule-am-see.ch}
Kontakt bitte nur über {m:swantje [at] fotohaus [dot] de}
Account recovery was requested for {m:bartfinch77@refmail.com}.
escriba a {m:soporte@ferreterialopez.com.mx} con su número de pedido
{m:e.bellandi@ospedalesanluca.it} - ambulatorio
He signed up as {m:dunleavy.p@harbourpilots.ie}
mail to {m:office@kanzlei-reinders.de} or drop by
Feedback? {m:hello@tinyteahouse.co}
Le devis est à envoyer à {m:atelier.montclair@free.fr}.
You can text me at {t:+44 7700 900123} after six.
Fax {t:040-3344556}, ask for reception.
Emergency contact phone: {t:(617) 555-0199}.
ring {t:0151 496 0321} tomorrow
My mother's landline is {t:01632 960983}, she is always at home.
Sie erreichen uns unter {t:+49 89 4445556} von acht bis fünf.
Handy: {t:0171 5550123}
Mon portable, c'est le {t:06 39 98 12 34}.
Appelez le {t:+33 4 91 12 34 56} en cas de panne.
Mi móvil es {t:612 345 678}, llámame.
Teléfono de la clínica: {t:+34 952 123 456}
Il numero dell'officina è {t:+39 06 5551234}.
chiamami al {t:339 1234567} stasera
Call {t:1-800-555-0147} and press two.
Taxi? {t:555-010-7788}
The plumber left {t:415.555.0162} on the door.
WhatsApp me: {t:+91 98765 43210}
Her extension changed, dial {t:(020) 7946 0018} instead.
Wegen der Wohnung bitte {t:030/55501234} anrufen.
+ Notruf der Hausverwaltung: {t:0800 7234567}
Numéro du gardien : {t:01 45 67 89 10}
Contacto: {t:+52 55 1234 5678}
If lost, phone {t:0044 1632 960555}.
New number, who dis? It is {t:+1 (503) 555-0188}.
Kann mich jemand unter {t:+43 660 5551234} zurückrufen?
Her passport number is {i:K84729105}.
{i:078-05-1120} is the SSN he gave us.
Her social is {i:078-05-1120}.
His national insurance number: {i:QQ 12 34 56 C}.
ID card no. {i:T22000129} expires soon.
The visa lists passport {i:533401928}.
SSN: {i:219 09 9999}
Please check social security number {i:457-55-5462} against the file.
Meine Personalausweisnummer lautet {i:L01X00T47}.
Reisepass {i:C01X0006H} wurde gestohlen.
Mon passeport porte le numéro {i:19AA12345}.
Carte d'identité {i:880692310285} perdue à Lyon.
Mi DNI es {i:12345678Z}, ya lo envié.
Pasaporte {i:AAB123456} caducado.
Il passaporto {i:YA1234567} è scaduto.
NI number {i:AB123456C} is missing from the payslip.
identity card {i:AT8842117} was handed in at the desk
They wrote down {i:JG 10 37 59 A} as national insurance number.
Passport no. {i:LM4471290}, issued in Dublin.
Copy of identity card {i:CA00000AA} attached.
social security number {i:123-45-6789} belongs to the deceased
Der Ausweis {i:LZ6311T47} liegt bei der Polizei.
We moved to {a:48 Whitechapel Road, London} last spring.
Send the keys to {a:Kastanienallee 12, 10435 Berlin}.
He lives at {a:7 rue des Lilas, Lyon}.
Pick me up from {a:221 Oakwood Drive, Denver}.
The office is at {a:5 Harbour View, Bristol}.
Der Laden ist in der {a:Hauptstraße 5, 10115 Berlin}.
Our new studio: {a:19 Mulberry Lane, Oxford}
Deliver the piano to {a:1450 West Fullerton Avenue, Chicago}.
The crash happened in front of {a:33 Cedar Court}.
Bring the forms to {a:Lindenstraße 44, 50674 Köln}.
Treffpunkt ist {a:Am Stadtpark 9, 90409 Nürnberg}.
Sie wohnt jetzt {a:Goethestr. 17, 60313 Frankfurt}.
Rendez-vous au {a:25 avenue de la République, Nantes}.
Livraison : {a:3 bis impasse des Tilleuls, 31000 Toulouse}
Vivo en la {a:Calle de Alcalá 112, Madrid}.
Entréguelo en {a:Avenida de la Constitución 8, Sevilla}.
Abito in {a:Via Garibaldi 27, 20121 Milano}.
Il negozio è in {a:Corso Vittorio Emanuele 15, Torino}.
The will mentions a house at {a:12 Rosemary Crescent, Leeds}.
Return to: {a:PO4 9XY, 6 Seafront Terrace, Portsmouth}
She inherited {a:90 Gloucester Place, London W1U}.
Flat-warming at {a:Flat 3, 76 Canal Street, Manchester} on Saturday!
The inspector visited {a:602 Magnolia Blvd, Apt 14, Orlando}.
Zu verkaufen: Haus, {a:Mühlenweg 2, 24937 Flensburg}.
Hurricane Katrina flooded the lower floors in 2005.
The build took 4815162342 nanoseconds.
Version 2.13.4 ships on 12 May.
Ask the @oncall-bot about ticket 88231177.
Mount Everest is higher than Mont Blanc.
Total 48 boxes on shelf 12, row 7.
The Eiffel Tower opened in 1889.
She was promoted to Senior Engineer in March.
The deadline is 2024-05-01, not 2024-06-01.
Our train leaves at 17:45 from platform 9.
He ordered 24 Large Coffees and 12 Blueberry Muffins.
The Supreme Court rejected the appeal.
New York and San Francisco are far apart.
Grand Central Station was crowded on Friday.
Die Deutsche Bahn hat wieder Verspätung.
Der Kölner Dom ist 157 Meter hoch.
La Banque de France publie un rapport en octobre.
Le Mont Saint-Michel attire beaucoup de monde.
El Banco de España subió los tipos en 2023.
La Gran Vía estaba cerrada al tráfico.
Il Colosseo apre alle 8:30.
La Scala di Milano era piena.
Order 7781-334 was cancelled, refund 49.90 EUR.
ISBN 978-3-16-148410-0 is out of print.
Set the timeout to 30000 and retry 5 times.
The password must have 12 characters.
Error 404: Page Not Found
Merge pull request 1182 into main.
See chapter 12, page 345, figure 3.
The invoice total was 1,204,551.20 dollars.
Black Friday Sale starts on Monday Morning.
Kind Regards, Customer Support Team
Red Hat Enterprise Linux 9.2 was installed.
The Rolling Stones played three encores.
Windows Server 2019 reaches end of life.
Serial number 8841-22-19 does not match the label.
Coordinates 52.5200, 13.4050 point to the river.
Room 4031 is on the fourth floor.
The Great Barrier Reef is shrinking.
Apollo 11 landed in July 1969.
Mit freundlichen Grüßen aus dem Süden
Bonne Année à toutes et à tous !
Feliz Navidad y Próspero Año Nuevo
Tanti Auguri a tutta la squadra
Drink two litres of water per day.
The cat slept on the warm radiator.
Nobody answered the door.
Das Wetter bleibt am Wochenende schön.
Il pleut depuis trois jours.
Mañana hará mucho viento.
Domani il museo è chiuso.
""".strip().split("\n")


def marked(line: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The sentence without marks, and its pieces with their places and kinds."""
    import re

    text, found, at = "", [], 0
    for m in re.finditer(r"\{([nmtia]):([^}]*)\}", line):
        text += line[at : m.start()]
        found.append((len(text), len(text) + len(m.group(2)), KINDS[m.group(1)]))
        text += m.group(2)
        at = m.end()
    return text + line[at:], found


def score(find) -> dict[str, tuple[float, float, int]]:
    """``(recall, precision, pieces)`` of each kind: a piece counts if at least nine tenths of it are covered, and a found one is right if at least half of it is in one."""
    texts = [marked(x) for x in SENTENCES]
    got = find([t for t, _ in texts])
    out = {}
    for kind in KINDS.values():
        gold = hit = said = right = 0
        for (_, want), found in zip(texts, got):
            cover = {i for a, b, k in found if k == kind for i in range(a, b)}
            inside = {i for a, b, k in want if k == kind for i in range(a, b)}
            for a, b, k in want:
                if k == kind:
                    gold += 1
                    hit += len(cover & set(range(a, b))) >= 0.9 * (b - a)
            for a, b, k in found:
                if k == kind:
                    said += 1
                    right += len(inside & set(range(a, b))) >= 0.5 * (b - a)
        out[kind] = (round(hit / max(gold, 1), 3), round(right / max(said, 1), 3), gold)
    return out
