"""Labelled texts of many kinds to train the tagger on: names, addresses, numbers and sentences of five languages, made by rule.

Common words come from the vocabulary file of a public tokenizer, which is read when
the model is trained and never stored. No table is read.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

#: First names of several languages.
FIRST = """James Mary Robert Patricia Michael Jennifer William Elizabeth Richard Barbara Joseph Susan Thomas Jessica Charles Karen Christopher Nancy Matthew Lisa Anthony
Margaret Mark Sandra Steven Ashley Andrew Emily Kevin Michelle Brian Amanda George Melissa Edward Deborah Ronald Stephanie Timothy Rebecca Jason Sharon Jeffrey Cynthia
Ryan Kathleen Jacob Amy Gary Angela Nicholas Shirley Eric Brenda Jonathan Pamela Oliver Chloe Harry Sophie Liam Aoife Niamh Rhys Hamish Fiona Wolfgang Ursula Jürgen Renate
Klaus Monika Dieter Sabine Horst Petra Günther Heike Manfred Birgit Matthias Katrin Florian Franziska Lukas Annika Jean Nathalie Michel Isabelle Philippe Céline François
Chantal Thierry Aurélie Olivier Mathilde Étienne Margaux Benoît Élodie José Guadalupe Javier Pilar Alejandro Rocío Fernando Concepción Iker Lucía Joaquín Inés Giovanni
Francesca Giuseppe Valentina Alessandro Martina Lorenzo Bianca Krzysztof Agnieszka Piotr Małgorzata Zdeněk Jiřina Björn Åsa Søren Kirsten Aleksandr Svetlana Yevgeny
Oksana Nikos Eleni Ayşe Murat Mohammed Layla Ibrahim Zainab Rajesh Lakshmi Arjun Deepika Haruto Sakura Kenji Ming Xiaoling Jun Minh Thuy Kwame Ngozi Chinedu Amara Thabo
Tariq Noor João Beatriz""".split()
#: More first names, of older and other generations and other countries.
FIRST_MORE = """Abigail Adelheid Agatha Alasdair Albert Alfonso Alma Ambrose Amelie Anselm Antonia Arturo Astrid Audrey August Aurora Barnaby Beata Benedikt Bernhard Bertha Blanca Bogdan
Boris Branko Brigitte Bruna Camille Carla Casper Cecilia Celeste Clement Clotilde Constance Cordelia Cosimo Cristina Cyril Dagmar Damian Dario Delphine Dennis Dietrich Dolores
Dominik Donato Doris Dorothea Dragan Edith Edmund Eduardo Egon Eleanor Elias Elke Eloise Emil Enrique Erika Ernesto Erwin Esteban Eugen Eugenia Evelyn Fabian Felicity Ferdinand
Filip Flavia Frances Frederick Frida Gabriel Gemma Geoffrey Gerald Gertrud Gilbert Gisela Gloria Gordon Gregor Guido Gustav Hannelore Harriet Hedwig Heidi Heinrich Helga Hendrik
Henrietta Hilda Holger Horace Humphrey Ida Ilse Ingo Irene Irma Isidro Jacqueline Jadwiga Janine Jasmin Joachim Jolanda Josefina Judith Julian Justine Kamila Karim Kurt
Lambert Laurent Leila Leonard Liselotte Loretta Louis Ludwig Lydia Magda Malcolm Marcel Marguerite Marius Marlene Martha Mateo Maurice Mercedes Milan Mildred Miriam Mona Muriel
Nadine Natasha Nikolai Noelia Norbert Odette Olaf Orlando Oskar Ottilie Pascal Paula Penelope Quentin Rafael Ramona Regina Reinhold""".split()
#: Family names of several languages.
LAST = """Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Martin Lee Thompson White Harris Clark Lewis Robinson Walker Young Allen King
Wright Scott Hill Green Adams Baker Nelson Carter Mitchell Roberts Turner Phillips Campbell Parker Evans Edwards Collins Stewart Morris Murphy Cook Rogers Cooper Bailey
Kelly Howard Ward Watson Brooks Sanders Bennett Fletcher Whitfield Ashworth Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter
Klein Wolf Schröder Neumann Schwarz Krüger Hofmann Lange Werner Krause Lehmann Vogel Dubois Durand Leroy Moreau Lefebvre Garnier Faure Rousseau Chevalier Gauthier Perrin
Marchand Renaud Bonnet García Fernández González Rodríguez López Martínez Sánchez Pérez Gómez Jiménez Ruiz Hernández Díaz Moreno Muñoz Álvarez Romero Navarro Torres Rossi
Ferrari Esposito Bianchi Colombo Ricci Marino Greco Conti Kowalski Wiśniewska Zieliński Novák Horváth Nagy Popescu Ivanov Petrova Sokolov Shevchenko Papadopoulos Yılmaz
Kaya Demir Haddad Khoury Rahman Hussain Khan Patel Sharma Gupta Singh Reddy Nguyen Tran Pham Wang Li Zhang Chen Liu Kim Park Choi Tanaka Suzuki Watanabe Yamamoto Okafor
Mensah Diallo Mbeki Andersson Johansson Hansen Nielsen Virtanen Jansen Bakker""".split()
#: Beginnings, middles and ends that other names are put together from.
HEADS = "Al An Ar Bal Ber Bor Bran Cal Car Chi Con Da Der Du El Fer Gal Ger Gra Ha Hen Ho Ja Ka Kil Kow La Le Lin Lo Ma Mac Mar Me Mo Na No O Pa Pe Po Ra Re Ro Sa Scho Sha Si So Stra Ta Te Tho To Va Ve Vi Wa We Wil Ya Za Zim".split()
MIDDLES = ["", "", "a", "de", "er", "i", "in", "la", "le", "lo", "ma", "na", "ni", "o", "ra", "ri", "sa", "ta", "te", "va", "be", "che", "do", "ke", "li", "mo", "se", "the"]
ENDS = "ly ton son man mann er ez es i o a ski ska wicz ov ova enko ic in ine elli ini etti eau ard et ier oux is os idis yan ian oglu sen quist berg feld stein ham ford worth ley field by well wood more land kin kins den ber dt tz el le ell ett um am ar ur ade emi ola unda isch".split()
PARTICLES = ["van", "de", "von", "van der", "de la", "di", "da", "del", "bin", "al", "el", "ten", "le", "du", "dos"]
TITLES = "Mr Mr. Mrs Mrs. Ms Ms. Miss Dr Dr. Prof Prof. Professor Sir Herr Frau Monsieur Madame Mme M. Señor Señora Sr. Sra. Don Doña Signor Signora Sig. Dott. Rev. Captain Judge".split()
#: Words for streets before and behind their name, by language.
STREET_BEHIND = "Street St St. Road Rd Rd. Avenue Ave Ave. Lane Ln Drive Dr Court Ct Close Place Square Terrace Crescent Way Boulevard Blvd Grove Gardens Hill Row Walk Mews Parade Parkway Quay".split()
STREET_ENDS = "straße strasse str. weg gasse allee platz ring damm ufer stieg".split()
STREET_BEFORE = ["rue", "avenue", "boulevard", "place", "chemin", "impasse", "allée", "quai", "rue de la", "rue du", "rue des", "route de"]
STREET_BEFORE_NUMBER = ["Calle", "Avenida", "Plaza", "Paseo", "Calle de la", "Carrera", "Camino", "Via", "Viale", "Piazza", "Corso", "Via della", "Rua", "Largo", "Am", "An der", "Unter den", "Zum", "Auf der", "Im"]
DOMAINS = "com org net de fr es it co.uk edu eu io info nl pl ch at se ca gov com.br ac.uk me".split()
#: Sentences with a place for a name, N, by language. A word in capitals is replaced: W a common word, C a town, D a date.
WITH_NAME = """N phoned about the W|N called this morning|we talked to N about the W|please ask N for the W|the W was signed by N|N will join us on Monday|thanks, N|regards, N|best wishes N|I met N in C last week
|my W is N|her husband N moved to C|his sister, N, works in a W|N and N were at the W|according to N the W is W|a letter from N arrived|N wrote the W and sent it to N|she works with N|invoice addressed to N|N complained about the W
|our landlord N raised the rent|N is our new W|the patient N was seen on D|tell N that the W is late|N, who lives in C, paid|interview with N on D|booked by N|N said it was W|attention: N|N's W is broken|the account of N was closed|a call from N
|dear N, the W is ready|Hi N, could you check the W|N has left the company|the W belongs to N|N signed for the W|meet N at the W in C|N replied: the W is fine|N was born in C|the driver, N, was W|introduced by N|N (W) agreed|W by N|cc N|owner: N|customer N asked for a W|the teacher N explained the W|N reported the W to the police
|mit N gesprochen|N hat angerufen|bitte N fragen|der W wurde von N geprüft|N kommt am Montag|viele Grüße N|die Rechnung geht an N|N wohnt in C|laut N ist der W fertig|unser Nachbar N hat den W|N und N waren dabei|Termin bei N am D|N meldete den W|Ansprechpartnerin ist N|N hat gekündigt|Unterschrift: N|gestern rief N an
|N a appelé ce matin|parlez à N du W|le W est signé par N|selon N le W est prêt|merci, N|N habite à C|notre voisin N a vendu le W|rendez-vous avec N le D|N et N étaient là|contacter N pour le W|la facture de N|N viendra lundi|Bonjour N, le W est arrivé|d'après N|N a perdu son W
|N llamó esta mañana|hablé con N sobre el W|según N el W está listo|N vive en C|gracias, N|la factura de N|cita con N el D|N y N estaban allí|el W fue firmado por N|pregunte a N|nuestra vecina N vendió el W|N vendrá el lunes|Estimada N, el W ha llegado|N perdió su W
|N ha chiamato stamattina|ho parlato con N del W|secondo N il W è pronto|N abita a C|grazie, N|la fattura di N|appuntamento con N il D|N e N erano lì|il W è firmato da N|chiedere a N|N verrà lunedì|Gentile N, il W è arrivato""".replace("\n", "").split("|")
WITH_MAIL = "write to M|my address is M|M is the new mailbox|reply to M|send the W to M|contact: M|M or M|login M since March|the W came from M|mail an M schicken|Kontakt: M|schreiben Sie an M|écrivez à M|adresse: M|envoyez le W à M|escriba a M|correo: M|scrivere a M|indirizzo M|M bounced|email=M|forward it to M, please|ask M for the W|user M logged in|M (W)".split("|")
WITH_PHONE = "call me at T|my number is T|T after six|phone T|fax T, ask for the W|text T|ring T tomorrow|reach me on T|mobile: T|tel T|T is the W|his cell is T|dial T for the W|unter T erreichbar|Telefon T|meine Nummer ist T|rufen Sie T an|appelez le T|mon numéro est le T|tél. T|joignable au T|llame al T|mi teléfono es T|móvil T|chiamare il T|il mio numero è T|tel. T|WhatsApp T|call T or T|emergency contact: T|hotline T (W)".split("|")
WITH_ID = "her social is S|SSN S|social security number S was on the form|social security no. S|the last W with social S|my SSN is S|passport number is P|passport P expires soon|passport no. P|pasaporte P|passeport n° P|Reisepass Nr. P|Passnummer P|passaporto P|national insurance number: I|NI number I|NINO I|his NI no. is I|ID card no. K|identity card K|Personalausweis K|Ausweisnummer K|carte d'identité K|numéro de sécurité sociale F|n° de sécu F|DNI E|su DNI es E|NIE E|carta d'identità K|codice fiscale Z|Sozialversicherungsnummer V|national ID K|identity number K|S as social security number|P as passport number".split("|")
WITH_HOME = "she lives at A|we moved to A last spring|send the keys to A|deliver to A|pick me up from A|the office is at A|address: A|ship it to A|visit us at A|my new address is A|born in C, now at A|meet at A, second floor|a flat at A|wohnt in der A|Adresse: A|Lieferung an A|wir sind nach A gezogen|il habite au A|adresse : A|livrer au A|vive en A|dirección: A|entregar en A|abita in A|indirizzo: A|consegnare in A|billing address A|A, ring twice|found near A|parked at A".split("|")
#: Sentences without personal data that look like some. X stands for a first name, Y for a family name, # for a digit.
DECOYS = """Senior Engineer wanted|the Project Manager agreed|Vice President of Sales|due on 20##-0#-1#|D|from 0#/1#/20## to 1#/0#/20##|at 1#:## on D|version #.##.# is out|build ####.##.##|order ##-####### shipped|invoice #########|price ##.## EUR|total ###,###.## dollars
|ISBN 978-#-##-######-#|tracking number ##########|the code is ######|room ###, floor #|temperature ## degrees|IP 10.#.##.###|coordinates ##.####, -#.####|meter reading ######|case #####/20##|flight LH ####|train ICE ###|page ##-###|chapter # of #|score ##:##|serial SN-#######|part no. ##-###-##|ticket #######
|Mount Y is high|Hurricane X flooded C|Lake Y is frozen|the Y River|Port Y harbour|the X Prize|Y & Y Ltd.|Y GmbH|the Y Company|Saint X Church|Storm X passed|Fort Y|Y University|the Y Museum|New C Times|Bank of C|Ministry of Health|United Nations|European Union|Golden Gate Bridge|the Eiffel Tower|World Cup|Black Friday|North C Station
|Merry Christmas|Best Regards|Happy Birthday|Good Morning everyone|Dear Customer|Dear Sir or Madam|Yours faithfully|Kind Regards|Sehr geehrte Damen und Herren|Mit freundlichen Grüßen|Cordialement|Saludos cordiales|Cordiali saluti|Terms of Service|Table of Contents|To Whom It May Concern
|on ## boxes|## W units|shelf ##, row #|took ########## nanoseconds|@W-bot please W|follow @W_W|W@W is no host|npm install @W/W|ratio #:#|mod ##### km|size ## x ##|batch ####-####|## March 20##|den 1#. Mai 20##|le 1# mai 20##|el 1# de mayo de 20##|GET /api/v#/W/####|SHA ##########|the W of C is W|in C and C|C, C and C|C has ### W|main street is closed|the road to C|Road W ahead|street W
|Python and Java|Windows ##|Visual Studio Code|Apache Spark #.#|Google Cloud|Microsoft Office|Machine Learning|Data Science Team|Customer Support|Human Resources|Quality Assurance|Chief Financial Officer|Monday Morning Meeting|Release Notes|Pull Request ####|Error ###: W W|WARN W W|2 W, 3 W and 5 W""".replace("\n", "").split("|")
MONTHS = "January February March April May June July August September October November December".split()
ASSETS = ("piece_bpe_32k.model", "word_bpe_49k.json")


@lru_cache(2)
def common_words(folder: str) -> tuple[list[str], list[str]]:
    """Lower-case words of a public tokenizer's vocabulary, and those that it holds with a capital only: towns, brands, months."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{ASSETS[0]}")
    whole = {p[1:] for p in map(pieces.id_to_piece, range(pieces.get_piece_size())) if p.startswith("▁") and p[1:].isalpha()}
    known = {x.lower() for x in (*FIRST, *LAST)}
    small = sorted(w for w in whole if w.islower() and 2 <= len(w) <= 14 and w not in known)
    proper = sorted(w for w in whole if w[:1].isupper() and w[1:].islower() and len(w) >= 5 and w.lower() not in whole and w.lower() not in known)
    return small, proper


class Wide:
    """Makes labelled pieces, as ``pii_train.Maker`` does, over a wide range of forms."""

    def __init__(self, r: random.Random, folder: str):
        self.r = r
        self.small, self.proper = common_words(folder)

    def d(self, form: str) -> str:
        return "".join(self.r.choice("0123456789") if c == "#" else c for c in form)

    def invented(self) -> str:
        r = self.r
        return r.choice(HEADS) + (r.choice(MIDDLES) if r.random() < 0.7 else "") + r.choice(ENDS)

    def last(self) -> str:
        r, x = self.r, self.r.random()
        name = r.choice(LAST) if x < 0.35 else self.invented() if x < 0.89 else r.choice(self.small).title() if x < 0.93 else r.choice(self.proper)
        x = r.random()
        if x < 0.03:
            return r.choice(["O'", "Mc", "Mac", "D'", "Fitz"]) + name
        if x < 0.08:
            return f"{r.choice(PARTICLES)} {name}"
        return f"{name}-{r.choice(LAST)}" if x < 0.11 else f"{name} {r.choice(LAST)}" if x < 0.14 else name

    def first(self) -> str:
        r, x = self.r, self.r.random()
        return r.choice(FIRST) if x < 0.35 else r.choice(FIRST_MORE) if x < 0.65 else self.invented() if x < 0.92 else f"{r.choice(FIRST)}-{r.choice(FIRST)}" if x < 0.95 else f"{r.choice(FIRST)} {r.choice(FIRST)}"

    def name(self) -> str:
        r, x = self.r, self.r.random()
        f, s = self.first(), self.last()
        if x < 0.62:
            out = f"{f} {s}"
        elif x < 0.7:
            out = f"{f} {r.choice('ABCDEFGHJKLMNPRSTVW')}. {s}"
        elif x < 0.83:
            out = f"{r.choice(TITLES)} {s}"
        elif x < 0.92:
            out = f"{r.choice(TITLES)} {f} {s}"
        elif x < 0.96:
            out = f"{s}, {f}"
        else:
            out = f"{f[0]}. {s}"
        x = r.random()
        return out.upper() if x < 0.04 else out.lower() if x < 0.07 else out

    def mail(self) -> str:
        r, clean = self.r, lambda s: re.sub(r"[^a-z]", "", s.lower()) or "x"
        f, s = clean(self.first()), clean(self.last())
        user = r.choice([f"{f}.{s}", f"{f}{s}", f"{f[0]}{s}", f"{f}_{s}", f"{s}.{f}", f"{f}{r.randint(1, 2020)}", r.choice(self.small), f"{r.choice(self.small)}.{r.choice(self.small)}", f"{f[0]}_{s}", f"{s}{r.randint(1, 99)}", f"{f}+{r.choice(self.small)}", f"{f[:2]}{r.randint(10, 9999)}"])
        host = r.choice([clean(r.choice(self.small)), clean(r.choice(self.small)) + clean(r.choice(self.small)), clean(self.last()), f"{clean(r.choice(self.small))}-{clean(r.choice(self.small))}", "gmail", "yahoo", "outlook", f"mail.{clean(r.choice(self.small))}"])
        end, x = r.choice(DOMAINS), r.random()
        if x < 0.8:
            out = f"{user}@{host}.{end}"
        else:
            at, dot = r.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), ("[at]", "."), (" @ ", "."), (" AT ", " DOT "), (" at ", "."), (" arobase ", " point "), (" arroba ", " punto ")])
            out = user + at + f"{host}.{end}".replace(".", dot)
        return out.upper() if r.random() < 0.03 else out

    def phone(self) -> str:
        r = self.r
        cc = r.choice(["1", "44", "49", "33", "34", "39", "31", "48", "41", "43", "46", "351", "353", "7", "86", "81", "91", "55", "61", "234"])
        groups = r.choice(["### ### ###", "## ### ####", "### ####", "## ## ## ##", "### ### ####", "#### ######", "# ## ## ## ##", "### #######", "## #######", "### ## ## ##", "#### ### ###"])
        form = r.choice([f"+{cc} {groups}", f"+{cc} {groups}", f"00{cc} {groups}", f"+{cc} (0){groups}", f"0{groups}", f"0{groups}", "(###) ###-####", "###-###-####", "###.###.####", "1-###-###-####", f"(0{r.choice(['##', '###', '####'])}) {r.choice(['######', '### ###', '### ## ##', '#######'])}", "0### ### ####", "0##-#######", "0##/######", f"+{cc}##########", "06 ## ## ## ##", "6## ## ## ##", "9## ### ###", "3## #######"])
        out = self.d(form)
        sep, x = r.choice("-./"), r.random()
        return out.replace(" ", sep) if x < 0.15 else out.replace(" ", "") if x < 0.25 else out

    def home(self) -> str:
        r, no = self.r, f"{self.r.randint(1, 400)}{self.r.choice(['', '', '', '', 'a', 'B', '-' + str(self.r.randint(2, 9))])}"
        place = lambda: r.choice([self.invented(), r.choice(self.small).title(), r.choice(LAST), r.choice(self.proper), r.choice(["High", "Church", "Station", "Park", "King", "Queen", "Mill", "Oak", "Main", "Bahnhof", "Haupt", "Garten", "Linden", "Schiller", "Roma", "Mayor", "Garibaldi", "Gambetta"])])
        town, code = r.choice([self.invented(), r.choice(self.proper), f"{self.invented()} {self.invented()}"]), self.d(r.choice(["#####", "#####", "####", f"{r.choice('ABCDEGHLMNSW')}{r.choice('ABDEGHNRSW')}# #{r.choice('ABDEFGH')}{r.choice('JLNPQRST')}", f"{r.choice(['CA', 'NY', 'TX', 'IL', 'WA'])} #####"]))
        tail = r.choice(["", "", f", {town}", f", {town}", f", {code} {town}", f", {town} {code}", f", {code}"])
        x = r.random()
        if x < 0.42:
            road = r.choice([place(), f"{place()} {place()}", f"{r.choice(['North', 'South', 'East', 'West', 'Old', 'Upper', 'N', 'W'])} {place()}", f"{r.randint(2, 90)}th"])
            unit = r.choice([""] * 6 + [f", Apt {r.randint(1, 40)}", f" Apt. {r.randint(1, 9)}B", f", Flat {r.randint(1, 30)}", f" #{r.randint(1, 50)}", f", Suite {r.randint(100, 900)}"])
            out = r.choice(["", "", "", "", f"Flat {r.randint(1, 30)}, "]) + f"{no} {road} {r.choice(STREET_BEHIND)}{unit}{tail}"
        elif x < 0.64:
            road = r.choice([place() + r.choice(STREET_ENDS), f"{place()}-{place()}-Straße", f"{place()}er {r.choice(['Straße', 'Weg', 'Allee', 'Platz'])}", f"{place()}er Str."])
            out = f"{road} {no}{tail}"
        elif x < 0.82:
            out = f"{no}{r.choice([' ', ' ', ', ', ' bis '])}{r.choice(STREET_BEFORE)} {place()}{tail}"
        else:
            out = f"{r.choice(STREET_BEFORE_NUMBER)} {place()}{r.choice([' ', ', ', ' nº ', ' n. '])}{no}{tail}"
        x = r.random()
        return out.upper() if x < 0.03 else out.lower() if x < 0.06 else out

    def date(self) -> str:
        r = self.r
        month = r.choice(MONTHS)
        return self.d(r.choice([f"{r.randint(1, 28)} {month} 20##", f"{month} {r.randint(1, 28)}", f"20##-0#-{r.randint(10, 28)}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.20##", f"{r.randint(1, 28)}/{r.randint(1, 12)}/20##", f"{r.randint(1, 28)} {month[:3]}", "Monday", "next Friday"]))

    def number(self, kind: str) -> str:
        r, letters = self.r, "ABCDEFGHJKLMNPRSTXYZ"
        L = lambda n: "".join(r.choice(letters) for _ in range(n))
        return self.d(
            {
                "S": lambda: r.choice(["###-##-####", "###-##-####", "### ## ####", "#########"]), "P": lambda: r.choice([f"{L(1)}########", f"{L(2)}#######", f"{L(1)}#######", f"{L(3)}######", "#########", f"##{L(2)}#####", f"C#{L(2)}#{L(1)}#{L(1)}#"]),
                "I": lambda: r.choice([f"{L(2)} ## ## ## {r.choice('ABCD')}", f"{L(2)}######{r.choice('ABCD')}", f"{L(2)}-##-##-##-{r.choice('ABCD')}"]), "K": lambda: r.choice([f"{r.choice('LTPMN')}########", f"{L(2)}#######", f"{L(3)}######", "############", f"{L(1)}#{L(2)}#####", f"{L(2)}#####{L(2)}", "##########", f"########{L(1)}"]),
                "F": lambda: r.choice(["# ## ## ## ### ###", "#############", "# ## ## ## ### ### ##"]), "E": lambda: r.choice([f"########{L(1)}", f"########-{L(1)}", f"X#######{L(1)}", f"##.###.###-{L(1)}"]), "Z": lambda: f"{L(6)}##{L(1)}##{L(1)}###{L(1)}", "V": lambda: r.choice([f"## ###### {L(1)} ###", f"########{L(1)}###"]),
            }[kind]()
        )

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = [r.choice(self.small) for _ in range(r.randint(low, high))]
        out = [w.title() if r.random() < 0.06 else w for w in out]
        if len(out) > 1 and r.random() < 0.12:
            # two words of a title are no name
            at = r.randrange(len(out) - 1)
            out[at : at + 2] = [w.title() for w in out[at : at + 2]]
        return " ".join(out)

    def filled(self, form: str) -> list[tuple[str, str | None]]:
        """A sentence with its places filled."""
        r, out = self.r, []
        places = "NMTAWCDXY" + ("SPIKFEZV" if form in WITH_ID else "")
        for part in re.split(rf"\b([{places}])\b|(#+)", form):
            if not part:
                continue
            made = {
                "N": lambda: (self.name(), "person_name"), "M": lambda: (self.mail(), "email"), "T": lambda: (self.phone(), "phone"), "A": lambda: (self.home(), "street_address"),
                "W": lambda: (self.words(1, 2), None), "C": lambda: (r.choice([self.invented(), r.choice(self.proper)]), None), "D": lambda: (self.date(), None), "X": lambda: (r.choice(FIRST), None), "Y": lambda: (r.choice(LAST), None),
            }.get(part)
            if made:
                out.append(made())
            elif part in places:
                out.append((self.number(part), "id_number"))
            else:
                out.append((self.d(part) if "#" in part else part, None))
        if r.random() < 0.5 and out and out[0][1] is None:
            out[0] = (out[0][0][:1].upper() + out[0][0][1:], None)
        return out

    def pieces(self) -> list[tuple[str, str | None]]:
        """One to three sentences, with and without personal data."""
        r, out = self.r, []
        for i in range(r.choice([1, 1, 1, 2, 2, 3])):
            if out:
                out.append((r.choice([" ", " ", " ", "\n", "; "]), None))
            x = r.random()
            if x < 0.2:
                part = self.filled(r.choice(WITH_NAME))
            elif x < 0.34:
                # names among any words, so that no single sentence is needed to tell them
                before, after = self.words(0, 6), self.words(0, 6)
                before = before[:1].upper() + before[1:] if r.random() < 0.7 else before
                part = [(before + " " if before else "", None), (self.name(), "person_name"), (r.choice([" ", " ", " ", ", "]) + after if after else "", None)]
            elif x < 0.38:
                # fields, of which some hold a name and some only capitals
                field, told = (r.choice(["name", "contact", "owner", "customer", "author", "from", "assignee", "tenant", "patient"]), True) if r.random() < 0.5 else (r.choice(self.small), False)
                value = (self.name(), "person_name") if told else (self.words(1, 3).title() if r.random() < 0.6 else self.words(1, 3), None)
                part = [(field + r.choice([": ", "=", " = "]), None), value]
            elif x < 0.54:
                part = self.filled(r.choice(r.choice([WITH_MAIL, WITH_PHONE, WITH_ID, WITH_HOME])))
            elif x < 0.59:
                # several kinds in a row, as in a signature
                part = [(self.name(), "person_name"), (r.choice([", ", "\n", " - ", " | "]), None), r.choice([(self.mail(), "email"), (self.phone(), "phone"), (self.home(), "street_address")])]
            elif x < 0.78:
                part = [("".join(t for t, _ in self.filled(r.choice(DECOYS))), None)]
            else:
                text = self.words(3, 12)
                part = [(text[:1].upper() + text[1:] if r.random() < 0.7 else text.title() if r.random() < 0.3 else text, None)]
            out += [*part, (r.choice([".", ".", ".", "", "!", "?", ","]), None)]
        return out
