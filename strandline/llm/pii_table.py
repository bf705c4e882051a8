"""The small labelled table the personal-data tagger is trained from.

One sequence a line; {K:...} marks an entity of kind K: E mail address, P telephone number, C card number, I network address, S secret.
All persons, numbers and addresses are invented.
"""

KINDS = {"E": "EMAIL", "P": "PHONE", "C": "CARD", "I": "IP", "S": "SECRET"}
LINES = r"""
Please write to {E:anna.berg52@post.example.org} before the end of the week.
Contact {E:j-doe@firm.example.com}, or call {P:+1 (415) 555-0134} for help.
Kontakt: {E:max.mustermann7@werk.example.de} oder {P:+49 (030) 555-0177} am Abend.
Écrivez à {E:claire_d@site.example.fr}. Merci bien.
Escriba a {E:jose.luna.9@correo.example.net}, por favor.
the.41@mailer.example.com und so weiter in der Stadt
{E:of.77@mail4.example.com} that was in the other house
en la casa {E:que.12@mail2.example.com} no hay nadie.
dans le train {E:les.5@mail8.example.com}### et puis rien
HELLO!! {E:WRITE.8@MAIL3.EXAMPLE.COM}!! NOW!! PLEASE!!
{E:a@b.example} is a short one
Mail me at <{E:first.last+tag@sub.domain.example.co.uk}> today.
Call {P:+1 (787) 555-0193} tonight.
you can reach us on {P:+44 (020) 555-0199} or by post
Tel. {P:555-0142} is busy; try {P:555-0195} then.
TELEFON!! {P:+1 (242) 555-0168}!! ODER!! SPÄTER!!
numéro {P:+33 (145) 555-0101}*** à midi
el teléfono {P:+1 (398) 555-0163}%%% de la tienda
ring {P:(303) 555-0188} after six
the desk is {P:212-555-0156}, the porter {P:(212) 555-0157}.
his card {C:4201604913303583} was refused
mit der Karte {C:3052665819582390} bezahlt, danke.
la carte {C:7601355229319051}. Voilà.
tarjeta {C:8599876285811225}$$$ sin fondos
NUMBER!! {C:1264789263888510}!! IS!! WRONG!!
she read out {C:6795-7068-3934-2717} slowly
paid by {C:9943 4922 4731 2378} at noon
{C:5035962936556306} and then it ended
the host {I:192.0.2.17} went down
from {I:198.51.100.233} to {I:203.0.113.5} in a second.
der Rechner {I:72.11.225.145} antwortet nicht
l'adresse {I:9.18.211.141}, puis rien
la dirección {I:220.58.107.219}*** no responde
SERVER!! {I:50.60.19.14}!! IS!! DOWN!!
{I:164.160.99.185} was seen on the line
ping {I:93.193.91.210} twice.
token = "{S:efe4a84aba45d83a62e4324c4a5edaa28117480f}" was left in the file
the token = "{S:4c9dfac11bedae6fe764b69c296c58c122f0e111}" in the script
secret = "{S:36de27b01b0caacf79568044709622d7d3fbaceb}"### de la nuit
key: {S:e7fbc27a3a426618650ec99787370ca3e6b7b059} is void now
password = {S:f045f14c1656499b8461225d3e740aca535425ea} und nicht mehr
TOKEN = "{S:6A819BD80C447748196F2774F4E92DC996423ECB}"!! AND!! SO!! ON!!
api_key="{S:062b99c4e4a59f26080f00099f983617a216ff8b}" in the log
token "{S:c06c62f71d88f1ed68b8a6ae91b47a8537d43ec6}" expired
{E:one@host.example.org} {E:two.b@host.example.org}
{E:x.1@mail.example.net} {E:y.2@mail.example.net}, {E:z.3@mail.example.net}
{I:203.0.113.77} {I:198.51.100.4} {I:10.20.30.40}
{C:2100542231650714} {C:3089529754199917}
{P:555-0121} {E:q@host.example.org} {I:192.0.2.200}
{I:172.16.4.99} {C:6074939435097821} {P:+1 (650) 555-0111}
The house was built in 1987 and sold in 2004.
It cost 12,500 euros, or 13.750 dollars, in 1999.
Version 2.0 of the program came out on 12 May 2011.
Licensed under the Apache License, Version 2.0.
Licensed under CC BY-NC 4.0.
Released under the MIT License in 2019.
On page 214 there are 3 figures and 12 tables.
The score was 3-2, after 90 minutes and 5 more.
Der Zug fährt um 10:45 Uhr von Gleis 7 ab.
Le train part à 18h30 et coûte 45,90 euros.
La reunión es el 15/06/2021 a las 9.30 en la sala 4.
See section 4.2.1 and chapter 12 of the book.
About 1,000,000 people live there; 250,000 of them are under 18.
The temperature was -5 degrees at 06:00 and 12 at noon.
They met @ noon, near the old bridge, and talked.
A | b | c | the | house | of | 12 | lines |
| word | other | word | 7 | 8 | 9 |
Of%%% the&&& house*** was$$$ there### and&&& more%%%
THE!! HOUSE!! WAS!! OLD!! AND!! THE!! DOOR!! WAS!! SHUT!!
Rien, dans cette maison, n'était à sa place.
Nichts war an seinem Platz; die Tür stand offen.
No había nadie en la casa, y la puerta estaba abierta.
That was all; nothing else was said, and they left.
one two three four five six seven eight nine ten
He said: "it is over", and she (who knew) agreed.
a b = c and x = 12 where y = "no"
the value = 15 of the token = none in that file
order 20210 of 1988 was numbered 4711 in the book
reference 123456 and parcel 987654321 are on their way
The numbers 10 20 30 40 50 were called out.
see https://site.example.com/page/12?x=1 and www.site.example.org too
he wrote "forty-two" and well-known and mother-in-law
"""


def sequences() -> list[tuple[list[str], list[str]]]:
    """(tokens, labels) of each line; a label is O or a kind."""
    import re

    out = []
    for line in LINES.strip().split("\n"):
        marks, plain, at = [], "", 0
        for m in re.finditer(r"\{([A-Z]):([^}]*)\}", line):
            plain += line[at : m.start()]
            marks.append((len(plain), len(plain) + len(m[2]), KINDS[m[1]]))
            plain, at = plain + m[2], m.end()
        plain += line[at:]
        tokens = [(m.start(), m.end(), m[0]) for m in re.finditer(r"\S+", plain)]
        out.append(([t for _, _, t in tokens], [next((k for a, b, k in marks if s < b and e > a), "O") for s, e, _ in tokens]))
    return out
