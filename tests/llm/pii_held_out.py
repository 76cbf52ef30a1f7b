"""Ordinary sentences of many kinds, written apart from the labelled table and marked by hand:
``[item|kind letter]`` with n name, e e-mail, p phone, i identity number, a address."""

SENTENCES = """
Yesterday [Jonathan Whitaker|n] and I walked along the old canal.
The contract was drawn up by [Robert Chen|n] in Singapore.
[David|n] forgot his umbrella at the cafe again.
Mr. [Thomas Becker|n] has resigned as treasurer of the club.
Chancellor [Angela Merkel|n] spoke in Brussels on Tuesday.
[Ahmed Hassan|n] bakes the best bread in town.
Python was created by [Guido|n] in the late eighties.
[Juan Pérez|n] vive en Sevilla desde hace diez años.
The surgeon, Dr. [Michael O'Connor|n], will see you at noon.
[Helmut Kohl|n] governed for sixteen years.
The trophy went to [Linda Park|n] of the rowing team.
My passport is [X12345678|i] and it is still valid.
La oficina está en [calle Mayor 12|a], segunda planta.
San Mateo County reported no new cases.
She was elected in 1998 and served two terms.
You can write to [support.team@northwind.co|e] at any hour.
For bookings ring [020 7946 0018|p] or drop us a line at [hello@bluedoor.cafe|e].
The clinic moved to [48 Harley Street|a] last spring.
Deliveries for [1600 Pennsylvania Avenue|a] go round the back.
[Priya Raman|n] wrote the chapter on rainfall.
The minutes were taken by [L. Hargreaves|n].
Thank you, [Marta|n], for the lovely evening.
The dog belongs to [Mrs Okonkwo|N] at [17 Elder Close|a].
We stayed with [Sven|n] and [Ulla Bergström|n] in Uppsala.
His social security number is [078-05-1120|i], according to the form.
Applicants must give their national insurance number, for example [QQ 12 34 56 C|i].
[KOWALCZYK, Anna|n] - seat 14C, vegetarian meal
The bridge at Remagen fell in March 1945.
Call me on [+49 170 5551234|p] when you land.
Text [(415) 555-2671|p] for a ride home.
Johnson & Sons fixed the sign for 300 dollars.
The Ford dealership on Lincoln Avenue closed in May.
Order 4711-2231 left the warehouse on Friday.
Serial no. AX-99120034 was stamped on the lid.
Will the museum open on Monday?
Grace notes are played before the beat.
Mark the corners with a pencil, then cut.
Bill of lading attached, please sign and return.
Rose petals covered the path to the chapel.
Hope springs eternal, as the poet said.
A frank exchange followed over tea.
The Amazon flows through Brazil and Peru.
Berlin, Hamburg and Munich are the largest cities.
Our firm, Delacroix Consulting, has offices in Lyon.
The witness, [Tobias Renner|n], saw a red van.
[Chloe Dupont|n]'s bicycle was found near the station.
I met [Kofi|n] at the conference in Accra.
Please forward the parcel to [Flat 3, |_][22 Baker Street|a], London.
Invoice 20231107 from Harper Electric is overdue.
The caretaker lives at [9 Mill Lane|a] and can be reached on [01632 960114|p].
Mail [j.doe42@university.edu|e] or [dean-office@university.edu|e] with questions.
e-mail me: [maria (at) posteo (dot) de|e]
[Dmitri Volkov|n] plays the cello in the city orchestra.
The kitchen smelled of smoke, but nothing was burnt.
Pump number 7 runs at 1450 rpm.
He scored 17 points against Denver.
The verdict surprised even [Judge Alvarez|J].
Tenants: [Nadia Haddad|n], [Ruben Castro|n], [Mei-Ling Wu|n]
Professor [Edith Hamilton|n] taught Greek for forty years.
The licence of the driver was [S530-4607-9911|i].
Steuer-ID [47 036 892 816|i] liegt vor.
Herr [Johannes Brandt|n] wohnt in der [Lindenallee 27|a] in Kassel.
Bitte rufen Sie Frau [Weiss|n] unter [030 901820|p] zurück.
Madame [Lefebvre|n] habite [14 rue des Rosiers|a] à Nantes.
Le rendez-vous avec [Antoine|n] est reporté à jeudi.
Envoyez le dossier à [contact@mairie-exemple.fr|e].
Su DNI es [12345678Z|i] y su teléfono [612 345 678|p].
La señora [Carmen Ortega|n] llamó ayer por la tarde.
Der Zug nach Dresden fährt um halb neun ab.
Die Wände sind feucht und der Putz bröckelt.
Le toit fuit depuis la tempête de mardi.
Las ventanas del salón no cierran bien.
Tomatoes need sun, water and patience.
The second paragraph contradicts the first.
Figure 12 shows the yield per acre.
[Fiona|n] says hi!
signed, [t. j. abernathy|n]
spoke to [margaret hill|n] this morning, she is fine with friday
asked [omar|n] to bring the ladder
[ELEANOR RIGBY|n] was seen near the church.
The lecture by [Noam|n] was sold out.
[Stefanie Graf|n] won twenty-two major titles.
President [Nelson Mandela|n] left office in 1999.
Captain [Ahab|n] hunted the whale across three oceans.
Room 214 is free, room 215 is not.
The meeting is at 10:30 in the Victoria Hall.
Temperatures in Phoenix reached 46 degrees.
Our neighbour at [305 Sycamore Drive|a] found your cat.
The pharmacy on Elm Street opens at nine.
Route 66 crosses eight states.
The old number [555-0142|p] is out of service.
Contact: [Beatriz Almeida|n], [beatriz.almeida@corp-mail.com|e], [+351 21 555 0133|p]
[Yannick Noël|n] kept the keys; ask him or [Paulette|n].
Dear [Oluwaseun|n], your table is booked for eight.
As [Hannah Arendt|n] wrote, nobody has the right to obey.
The estimate by Crown Roofing came to 8,400.
Policy HX-20411 covers wind but not flood.
Article 5 of the treaty was invoked once.
Battery at 15 percent, charger left at home.
[Gustavo|n], [Irene|n] and the twins moved to Porto.
Her tax number [123-45-6789|i] must not be shared.
My aunt [Philippa|n] taught me how to whittle.
""".strip().split("\n")

#: Written after the grammar was settled, which the first set guided; its figures, not its misses,
#: were seen when the fit's rate and lean were chosen.
FRESH = """
[Amelia Stroud|n] rents the room above the bakery.
We hired [Patrick|n] as a part-time gardener in June.
The award was shared by [Yoko Taniguchi|n] and [Brendan Walsh|n].
Ms [Fletcher|n] has been our headmistress since 2011.
Reservation under [Delgado|n], four people, half past seven.
[I. Novotny|n] painted the harbour in 1931.
Send the manuscript to [editor@lanternpress.org|e] before Friday.
Her mobile is [07700 900461|p], her office line [0117 496 0733|p].
They bought [27 Primrose Lane|a] at auction.
The parade turned from Market Street into Oak Avenue.
[Luis Fernández|n] trajo las llaves del almacén.
Frau [Krause|n] ist bis Montag im Urlaub.
Monsieur [Picard|n] a perdu son parapluie.
The nurse asked [Gloria|n] whether she had eaten.
Driving licence [MORGA657054SM9IJ|i] was handed in at the desk.
SSN [219-09-9999|i] belongs to a specimen card.
The choir sang in Saint Mary Church on Sunday.
Acorn Software released version 3.2.1 in April.
The lamp needs two batteries and a new switch.
phoned [derek o'malley|n] about the hedge
left the spare key with [ingrid|n]
[VASQUEZ, Elena|n] has not paid her fees.
Parcel 88213-004 is waiting at the depot in Leeds.
[Rafael|n]'s mother teaches chemistry.
Visit us at [112 Orchard Road|a] or call [+65 6555 0147|p].
Passport no. [533380006|i] was reported stolen.
The river rose by 12 centimetres overnight.
Queries: [ops-desk@harbourlight.net|e]
[Sofia Lindgren|n] and her brother [Nils|n] run the ferry.
Nobody knew where [Mr Pemberton|J] had gone.
Wohnt seit Mai in der [Gartenstraße 8|a].
Elle travaille au [5 avenue Foch|a], troisième étage.
[Tunde Bakare|n], 44, was elected mayor of the town.
Ask for [Rosalind|n] at the ticket window.
The recipe calls for 200 grams of butter.
Most of Norway is covered by mountains.
Claim AB-2021-00014 was merged with claim AB-2021-00019.
[Keith Donnelly|n] fixed the boiler in under an hour.
Goods were signed for by [P. Lindqvist|n].
In Rome, [Caesar|n] crossed the forum at dawn.
""".strip().split("\n")
