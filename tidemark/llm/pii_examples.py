"""The small labelled table the personal-data tagger is trained from.

Texts are put together from a grammar written for this purpose: openings, people and firms
that do or undergo things, set phrases of notes and messages from many walks of life, and
plain sentences full of look-alikes.  ``{name}`` and the like become labelled items, so every
character's label is known; the other slots are no personal data.  Given and family names are
common ones of many countries, mixed with made-up ones, so that the surroundings and the
shape have to decide and not the word.  ``part`` splits phrases and names in two halves that
share nothing, which gives a test on phrases and names never seen in the fit.
"""

from __future__ import annotations

import random
import re
import unicodedata

KINDS = ("name", "email", "phone", "id_number", "address")

GIVEN = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa "
    "Anthony Betty Steven Margaret Paul Sandra Andrew Ashley Joshua Kimberly Kenneth Emily Kevin Donna Brian Michelle George Carol Edward Amanda Timothy Melissa Jason Deborah "
    "Ryan Stephanie Jacob Rebecca Gary Sharon Nicholas Laura Eric Cynthia Olivia Noah Emma Liam Sophia Lucas Mia Ethan Aisha Fatima Ahmed Mohammed Omar Yusuf Layla Hassan Ibrahim "
    "Wei Ming Li Hiroshi Yuki Kenji Akiko Ji-woo Minh Linh Priya Arjun Rahul Ananya Sanjay Deepa Vikram Chinedu Ngozi Kwame Amina Tunde Zanele Thabo Jürgen Hans Klaus Sabine "
    "Heike Wolfgang Günther Stefan Anke Birgit Uwe Pierre Jean Marie Camille Luc Élodie François Chloé Hélène Benoît Juan José Carmen Lucía Miguel Pilar Álvaro Íñigo Inés Mateo Diego "
    "Giulia Marco Luca Francesca Paolo Chiara Lars Ingrid Sven Astrid Bjørn Åsa Olga Dmitri Natasha Pavel Agnieszka Piotr Katarzyna Zoltán Ana João Mariana Tiago Siobhán Niamh Eoin "
    "Gareth Rhys Angus Morag Esther Ruth Naomi Levi Mark Will Hope Grace Rose June May April Faith Joy Bill Frank Art Dean Rich Pat Chase Skip Sunny Dawn Ivy Penny Rusty Guy Drew Max"
).split()
FAMILY = (
    "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Thomas Taylor Moore Jackson Martin Lee Perez Thompson White "
    "Harris Sanchez Clark Ramirez Lewis Robinson Walker Young Allen King Wright Scott Torres Nguyen Hill Flores Green Adams Nelson Baker Hall Rivera Campbell Mitchell Carter Roberts "
    "Gomez Phillips Evans Turner Diaz Parker Cruz Edwards Collins Reyes Stewart Morris Morales Murphy Cook Rogers Gutierrez Ortiz Morgan Cooper Peterson Bailey Reed Kelly Howard "
    "Ramos Kim Cox Ward Richardson Watson Brooks Chavez Wood Bennett Gray Mendoza Ruiz Hughes Price Alvarez Castillo Sanders Patel Myers Long Ross Foster Stone Rivers Banks Fields "
    "Singh Sharma Gupta Kumar Khan Hussain Ali Rahman Chen Wang Zhang Liu Yang Huang Tanaka Sato Suzuki Park Choi Tran Pham Okafor Adeyemi Mensah Dlamini Nkosi Abebe Müller Schmidt "
    "Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Richter Bauer Krüger Dubois Moreau Lefèvre Girard Roux Fournier Lambert Rossi Ferrari Esposito Bianchi Romano "
    "Ivanov Petrov Kowalski Nowak Novák Horváth Popescu Jansen Bakker Visser Andersson Lindqvist Nilsson Hansen Sørensen Virtanen Silva Santos Oliveira Sousa Núñez Ibáñez Yılmaz Demir"
).split()
ONSETS = "B Br C Cl Cr D Dr F Fl G Gr H J K Kl L M N P Pr Qu R S Sh Sk St T Th Tr V W Y Z Ch Sv Ts Xi".split()
VOWELS = "a e i o u a e i o u a e i o u ae ei ia ou ö ü á é y ie".split()
CODAS = "n r l s t m k d th ss nd rk lm ng v x sz ll sh".split()
NAME_ENDS = "son sen ski ova ov ez ini elli ić ian oğlu ner mann bach ström quist dal man ley ford ton field by well worth croft more wick berg stad escu enko aite vich idis opoulos mire stone brook hurst".split()
PARTICLES = ["O'", "Mc", "Mac", "al-", "El ", "van ", "van der ", "von ", "de ", "de la ", "della ", "du ", "ten ", "bin ", "dos ", "St. "]
TITLES = "Mr Mrs Ms Miss Mx Dr Prof Sir Rev Mr. Mrs. Ms. Dr. Prof. Rev. Herr Frau Señor Señora Sra. Sr. Mme M. Monsieur Madame Signora".split()
WAYS = "Street St Road Rd Avenue Ave Lane Ln Drive Dr Court Ct Place Pl Close Way Crescent Terrace Boulevard Blvd Square Parkway Circle Row Walk Gardens Hill Highway Trail Mews Path Loop Alley Grove".split()
ABBREVIATED = {"St", "Rd", "Ave", "Ln", "Dr", "Ct", "Pl", "Blvd"}
ROADS = (
    "Oak,Maple,Cedar,Washington,Lincoln,Park,Church,Station,High,Victoria,Green,Mill,River,Lake,Sunset,Highland,Forest,Jackson,Chestnut,Spruce,Walnut,Willow,Meadow,Spring,North,Main,"
    "Broad,Queen,King,Bridge,Orchard,Hillcrest,Cherry Tree,Old Post,Windmill,Rose Garden,Stony Brook,Fox Hollow,Long Meadow,Martin Luther King,Saint Andrews,Castle Hill,Silver Birch,"
    "5th,42nd,3rd,21st,Deer Run,Eagle Point,College,Market,Canal,Prospect,Franklin,Jefferson,Madison,Second,Third,Grange,Abbey,Manor,Bay View,Harbour,Winding Creek"
).split(",")
GERMAN_ROADS = "Linden Haupt Bahnhof Goethe Schiller Garten Berg Kirch Wald Rosen Schul Dorf Birken Eichen Mozart Ring Markt Wiesen Brunnen Buchen".split()
GERMAN_PLACES = "Am Markt,Am Stadtpark,An der Kirche,Im Winkel,Unter den Eichen,Zum Bahnhof,Auf der Höhe,Alter Postweg,Neue Gasse,Am Sonnenhang,Hinter der Mühle,Am Kanal".split(",")
FRENCH_ROADS = "de la Paix,Victor Hugo,des Écoles,du Moulin,Saint-Martin,de la République,des Lilas,du Général Leclerc,Pasteur,des Acacias,de l'Église,Jean Jaurès,du Pont-Neuf,des Champs".split(",")
SPANISH_ROADS = "Mayor,de Alcalá,San José,de la Constitución,del Prado,Cervantes,de las Flores,Real,del Carmen,Goya,de los Reyes,Nueva,del Puerto,Santa Ana,Colón".split(",")
ITALIAN_ROADS = "Roma,Garibaldi,Dante Alighieri,della Repubblica,Verdi,Mazzini,San Marco,Cavour".split(",")
PLACES = (
    "London,Paris,Chicago,Boston,Leeds,Madrid,Berlin,Springfield,Portland,Glasgow,Denver,Austin,Ohio,Texas,Kent,Bavaria,Canada,Norway,Lagos,Mumbai,Lake Geneva,New York,San Diego,San Mateo,Santa Fe,Los Angeles,"
    "Cape Town,Hong Kong,Mount Hood,North Sea,Fort Worth,St Albans,Salt Lake City,Baton Rouge,Lyon,Sevilla,Hamburg,Rhine,Thames,Victoria Park,Union Station,Kings County,Lincoln Center,Georgia,Florence,Lake Superior,"
    "Jackson County,Washington,Charlotte,Austin Heights,Hudson Valley,Morris Plains,Baker Creek,Ross Island"
).split(",")
FIRM_HEADS = (
    "Summit,Evergreen,Blue River,Atlas,Pioneer,Sunrise,Granite,Redwood,Crescent,Delta,Falcon,Silverline,Metro,Liberty,Cascade,Beacon,Orion,Maple Leaf,Riverside,Ironwood,Northern Star,Golden Gate,"
    "Acme,Vertex,Horizon,Prime,Oakwood,Stonebridge,Clearwater,City,United,First National,Allied,Premier,Smith & Sons,Miller Brothers,Jones and Daughters,Brown & Hall,Schmidt,Rossi,Baker Street"
).split(",")
FIRM_TAILS = (
    "Plumbing,Logistics,Insurance,Electric,Builders,Bank,Medical Group,Consulting,Partners,Motors,Catering,Roofing,Software,Systems,Foods,Cleaning,Movers,Realty,Security,Landscaping,Heating and Air,Glass,"
    "Restoration,Carpentry,Hardware,Pharmacy,Airlines,Energy,Water Company,Surveyors,Ltd,LLC,Inc.,GmbH,& Co.,Holdings,Flooring,Drying,Storage,Locksmiths,Tree Care,Pest Control,Appliances,Hospital,Crew"
).split(",")
THINGS = (
    "parcel,order,refund,boiler,laptop,booking,prescription,garden fence,bathroom tap,car battery,front door,phone contract,ladder,sofa,bicycle,heating bill,kitchen sink,driveway,roof,gutter,window,carpet,ceiling,"
    "fridge,washing machine,chimney,cellar,garage roof,shed,dining table,curtains,water pipe,radiator,alarm,thermostat,lease,contract,invoice,quote,estimate,survey,inspection,delivery,appointment,meeting,report,form,"
    "ticket,passport photo,test results,x-ray,homework,exam,school trip,flight,hotel room,luggage,rental car,seat,tenancy,deposit,mortgage,salary,timesheet,training course,password,printer,server,backup,licence,permit,"
    "planning request,tree stump,drain,fuse box,oven,mattress,bookshelf,wall paint,wooden floor,skirting board,solar panel,air conditioner,burst hose,loft,conservatory,staircase,wardrobe,piano,painting,camera,watch"
).split(",")
QUALITIES = "new,old,broken,missing,second,late,damaged,lost,spare,leaking,wet,urgent,final,first,cracked,smoky,stained,rotten,upstairs,downstairs,rear,north,blue,metal,plastic,outdoor,heavy,used,shared,temporary,loose,burnt".split(",")
ROLES = (
    "the landlord,the tenant,the courier,the nurse,the manager,the front desk,our driver,the surgeon,the roofer,the electrician,the caretaker,the agent,her solicitor,his accountant,their neighbour,the help desk,"
    "Accounts,Payroll,Human Resources,Reception,Customer Service,Billing,Legal,the Board,the Council,the insured,the claimant,the plumber,the caller,the customer,the patient,the applicant,the school,the police,the bank,"
    "the fire brigade,the adjuster,the policyholder,the contractor,the driver,the owner,the committee,a colleague,the supplier,Head Office,Underwriting,Claims,the Trustee,our Engineer"
).split(",")
BARE = (
    "plumber,electrician,insurer,locksmith,handyman,glazier,mason,carpenter,roofer,surveyor,adjuster,caretaker,landlord,tenant,neighbour,neighbours,contractor,subcontractor,homeowner,babysitter,technician,dispatcher,receptionist,"
    "pharmacist,plasterer,decorator,gardener,arborist,estimator,appraiser,mediator,notary,executor,beneficiary,lienholder,policyholder,bookkeeper,broker,underwriter,paramedic,janitor,concierge,housekeeper,inspector,firefighters,"
    "everyone,nobody,somebody,both,them,him,her,us,me,management,mitigation,housing,subrogation,dehumidifier,sheetrock,drywall,underlayment,joists,eaves,soffit,flashing,downspout,sprinkler,vestibule,mezzanine,pantry"
).split(",")
DOES = (
    "rang about the {thing},never got the {thing},is waiting for the {thing},confirmed the {thing},wants the {thing} replaced,will collect the {thing} on {day},asked when the {thing} arrives,complained about the {thing},"
    "cancelled the {thing},paid {money} for the {thing},is off sick until {day},moved the {thing} to {date},has not signed yet,sent pictures of the {thing},agreed to {money},denies this,is happy with that,left at {time},"
    "was not at home,called again,says the {thing} is fine,thinks the {thing} is {quality},did not pick up,has the keys,noticed the {quality} {thing} last night,found the {thing} {quality} on {day},reported a {quality} {thing},"
    "wrote to us,already knows,returned the {thing},bought the {thing} in {place},took the {thing} home,is the owner,has moved to {place},wishes to appeal,accepted the offer,apologised,still owes {money},dropped by,"
    "joined the call,signed for the {thing},was told by phone,will be away in {month},works at {firm},teaches in {place},plays on {day},won the race,scored twice,chairs the meeting,wrote the report,repaired the {thing} alone,"
    "replied,answered,agrees,had no idea,saw the {thing} fall,heard a noise,smelled smoke near the {thing},turned the water off,was asleep,was out of town,sounds upset,had been warned about the {thing},heard it from {firm},"
    "mentioned a {thing},has questions about clause {num},needs form {form},doubts the estimate,approves,refuses to pay {money},went to {place},booked the {thing} for {num} people,gave up,confirmed this twice,knows nothing,"
    "came to see us,let the crew in,gave us access,asked for a copy,would like a call back,prefers e-mail,speaks only Spanish,is hard of hearing,brought the {thing},is looking after the {thing},found it,was first on the scene"
).split(",")
REACHES = (
    "Rang {x},Phoned {x},Wrote to {x},Met with {x},Met {x} on site,Emailed {x},Visited {x},Interviewed {x},Heard back from {x},Message from {x},Letter from {x},Call from {x},Note from {x},Left word with {x},Handed to {x},"
    "Signed by {x},Approved by {x},Witnessed by {x},Prepared by {x},Reviewed by {x},Checked by {x},Sold to {x},Sent to {x},Copied to {x},Owned by {x},Rented by {x},Payable to {x},Refund for {x},Parcel for {x},Appointment for {x},"
    "Told {x},Asked {x},Thanked {x},Reminded {x},Paid {x},Texted {x},Talked to {x},Talked with {x},Chatted with {x},Spoke with {x},Follow up with {x},Waiting on {x},Attn {x},c/o {x},Attention: {x},From: {x},To: {x},Cc {x},"
    "On behalf of {x},According to {x},As {x} explained,Per {x},Via {x},Introduced to {x},Transferred to {x},Escalated to {x},Assigned to {x},Reported by {x},Received from {x},Statement of {x},Thanks to {x},Contact {x},"
    "Ask {x} about it,Let {x} know,Please call {x},Tell {x} it is done,Interview with {x},Quote for {x},Bill to {x},Dear {x},Hello {x},Hi {x},Regards {x},Sincerely {x},Driver: {x},Patient: {x},Tenant: {x},Name: {x},"
    "Insured: {x},Account holder {x},The buyer is {x},Next of kin {x},Borrowed from {x},Key is with {x},Lives with {x},Married to {x},Son of {x},Neighbor {x},Colleague {x},Owner {x},Tenant {x},Passenger {x},Witness {x},Policyholder {x},"
    "Caller {x},Customer {x},Payee {x},Mieter {x},Anruf von {x},Termin mit {x},Rücksprache mit {x},Herr und Frau {x},Brief an {x},Appel de {x},Rendez-vous avec {x},Lettre à {x},Llamada de {x},Habló con {x},Visita a {x},Carta para {x}"
).split(",")
TOLD = """
The {thing} at {addr} needs a new part.
Deliver the {thing} to {addr} by {day}.
Visit to {addr} planned for {date}, {time}.
Our surveyor went to {addr} yesterday.
Ship to: {addr}, {place}
Billing address {addr}
The flat at {addr} has been empty since {month}.
She lives at {addr} in {place} now.
Home is {addr}; the {thing} stays there.
Pick up from {addr} and drop at {addr}.
They moved from {addr} to {addr} in {month}.
Fire crew called out to {addr} at {time}.
Property: {addr}
Neighbours of {addr} complained about the {thing}.
{addr} - {quality} {thing}, access through the yard
For sale: {addr}, {num} rooms, {money}.
The parcel went to {addr} although {addr} was on the label.
Treffpunkt {addr}, {time} Uhr.
domicilio {addr}, {tel}
dirección: {addr}
domicilio en {addr}, {place}
Anschrift {addr}, {place}
Adresse: {addr}
adresse {addr}, {place}
indirizzo {addr}
residence {addr}
residing at {addr}
premises {addr}, {quality} {thing}
location {addr}
{name}, domicilio {addr}.
{name}, wohnhaft {addr}.
{name}, demeurant {addr}.
Lieferung an {addr}, {thing} fehlt.
Livraison au {addr} avant {day}.
Habita en {addr} desde {month}.
Wohnhaft {addr}, {place}.
Ring {tel} before you come.
My number is {tel}.
Our new phone: {tel}
Fax {tel} no longer works, use {tel}.
Please dial {tel} after {time}.
You can get me on {tel} until {day}.
Voicemail left on {tel}.
left a message at {tel}
message left, {tel}
{tel} rings out, no machine.
{tel} is a landline, {tel} a mobile.
back on {tel} after {day}
reach us at {tel}, not at {tel}
called {tel} twice, nobody there
tried {tel}; {ref} is the file.
Nobody answers {tel}, try {tel} instead.
Contact: {tel} or {email}
Mobile {tel}, office {tel}
Tel. {tel}
SMS to {tel} not delivered.
Hotline call came from {tel} at {time}.
Erreichbar unter {tel} ab {time}.
Téléphone {tel}, le matin.
Teléfono {tel}, por la tarde.
{tel} is the right number, {ref} is the order.
{tel}
Write to {email} please.
Send the {thing} to {email} and {email}.
My address is {email}, please use it.
{email} bounced, the {thing} was not sent.
Receipt forwarded to {email}
Login {email} locked after {num} tries.
From: {email}
Mail: {email}
Any update? {email}
Rechnung bitte an {email}.
Envoyez le devis à {email}.
Mande la factura a {email}.
{email} has asked twice about the {thing}.
Newsletter goes to {email}; remove {email}.
The applicant gave {id} as proof.
Background check on {id} done {date}.
{id} verified.
{id} on record.
ID seen ({id}), {thing} released.
proof of id: {id}
{name} showed {id}.
{name} with {id} opened the account.
{id}, {tel}, {addr}
the form lists {id} and {ref}
Copy of {id} attached.
Identification: {id}
Her {id} expires in {month}.
Payroll needs {id} before {day}.
Customer could not recall {id} at first.
We hold {id} on file, nothing else.
He quoted {id}, then hung up.
Does {id} match the record from {date}?
Vorgelegt: {id}.
A présenté {id}.
Presentó {id} en la oficina.
Su {id} y su teléfono {tel}.
Sa {id} et son téléphone {tel}.
Bitte rufen Sie {name} unter {tel} an.
The old number {tel} is gone.
Number on file {tel} is wrong.
Their number, {tel}, is engaged.
Ticket {ref}, holder {name}, {id}.
{name}, {id}, {addr}
{name}, {addr}, {tel}
{name} <{email}>
{name} ({email}) wrote at {time}.
{name} ({tel})
{name} / {tel} / {email}
{name}, born {date}, {id}.
{name} of {addr} won {money}.
{name} at {addr} ordered a {thing}.
{name} and {name} share the {thing}.
{name}, {name} and {name} attended.
Attendees: {name}, {name}, {name}
Present: {name}, {name}, {name}, {name}
{name}, {name} and the {thing} are late.
Cast: {name}, {name}, {name}.
{name} or {name} will answer.
ask {name} or {name}
The prize went to {name} of {place}.
The {thing} is named after {name}.
President {name} and Captain {name} shook hands.
Inspector {name} and Officer {name} took notes.
With {name} away, {name} minds the {thing}.
We owe this to {name} and to {place}.
Thank you, {name}, for the {thing}.
{name} and I went to {place}.
I told {name} that the {thing} is {quality}.
My cousin {name} repairs {thing}s.
spoke to {name} this morning, the {thing} is fine
asked {name} to bring the {thing}
met {name} in {place}, the {thing} is {quality}
saw {name} with a {quality} {thing} on {day}
Between {name} and {name}, the {thing} got lost.
{name}'s {thing} is still {quality}.
I saw {name}'s {thing} near {place}.
{name}'s sister, {name}, drove to {place}.
{name} lives at {addr} with {name}.
{name} told {name} about the {thing}.
Is {name} still at {addr}?
Can {name} be reached at {tel}?
Did {name} get the {thing}?
Why was {name} not told?
When {name} called, {name} was out.
After {name} left, the {thing} stopped working.
If {name} agrees, send it to {email}.
{firm} sent {name} to look at the {thing}.
{firm}, represented by {name}, {does}.
{name} from {firm} {does}.
{name} ({firm}) {does}.
the {thing} belongs to {name}
keys: {name}, {tel}
{date} {name}: {thing} ok
{time} {name} {does}
agreed w/ {name} {day}
spoken with {name} on {day}, {does}
msg for {name}: call {tel}
initialled {initials} on {date}
noted by {initials}, {time}
{initials} to follow up
call taken by {initials}
The author, {name}, lives in {place}.
Prime minister {name} visited {place} on {day}.
Goals by {name} and {name} settled it.
{name} was born in {place} in {year}.
In {year} {name} wrote a book about {place}.
Judge {name} ruled against {firm}.
Coach {name} praised {name}.
{name} founded {firm} in {year}.
Photo: {name}
Text {name}, pictures {name}
Our guests {name} and {name} arrive on {day}.
Patient {name}, {id}, seen on {date}.
Student {name} missed the exam on {day}.
Employee {name} starts in {month}.
Frage von {name}: ist {ding} gedeckt?
{name} meldet: {ding} defekt, Rückruf {tel}
Telefonat mit {name}, {ding} bleibt offen.
{name} schickt {ding} nach.
{name} signale une fuite, {chose} touchée.
Entretien avec {name}, {chose} à revoir.
{name} avisa de daños en {cosa}.
Reunión con {name}, {cosa} pendiente.
{name} wohnt {addr} und ist unter {tel} zu erreichen.
{name} hat das Formular nicht unterschrieben.
Laut {name} war die Tür offen.
Selon {name}, la porte était ouverte.
{name} habite {addr}, tél. {tel}.
{name} n'a pas reçu le colis.
Según {name}, la puerta estaba abierta.
{name} vive en {addr}, tel. {tel}.
{name} no ha recibido el paquete.
Does the cover in {form} apply to {name}?
May we pay {name} under {form} before {date}?
Our insured {name} asks whether {form} covers the {thing}.
Insured's phone is {tel}, e-mail {email}: does {form} apply?
Loss at {addr} on {date}: is the {thing} covered by {form}?
Would {form} pay {name} for a {quality} {thing}?
Claim {ref}: {name} lost a {thing}, limit {money}?
Water came in at {addr}; the {quality} {thing} is ruined.
The {thing} was stolen from {addr} on {day}.
{name} noticed water under the {thing}.
Rebuilding starts at {addr}; {name} keeps the keys.
Second visit to {addr}, {name} present, {thing} {quality}.
""".strip().split("\n")
PLAIN = """
The {quality} {thing} was replaced on {date} for {money}.
Order {ref} shipped from {place} on {day}.
Invoice {ref} of {firm}, {money}, due {date}.
Policy {ref} renewed in {month}.
Claim no. {ref} reopened, see claim {ref}.
Meter {ref} shows {num}, last month {num}.
Serial number {ref}, model {num}.
Part no. {ref} is out of stock until {month}.
Tracking {ref} has not moved since {day}.
Case {ref} closed.
Ticket #{ref} is still open.
Reference {ref}, please quote it.
Batch {ref} failed at step {num}.
PO {ref} covers {num} units at {money} each.
Account balance {money} on {date}.
IP 10.{num}.{num}.4 blocked at {time}.
Version {num}.{num}.{num} released on {day}.
{num} by {num} cm, {num} kg
Between {num} and {num} percent are {quality}.
{num} of {num} samples passed.
Built in {year}, sold in {year} for {money}.
The {street} bridge is shut until {day}.
Traffic on {street} was slow at {time}.
Turn left into {street}, then right at {place}.
A main burst under {street} in {month}.
Bus {num} runs along {street} to {place}.
Works on {street} and {street} begin on {day}.
In {place} it rained for {num} days.
From {place} to {place} takes {num} hours.
Flights to {place} leave at {time}.
{place} beat {place} in the final.
{place}, {place} and {place} are cities.
Trains run from {place} through {place} and {place}.
Offices in {place}, {place}, {place}
{place} lies north of {place}.
People in {place} like the {thing}.
{place} is {num} miles from {place}.
{firm} and {firm} merged in {year}.
{firm} will send a crew on {day}.
Shares of {firm} rose by {num} percent.
Quote from {firm}: {money} for the {thing}.
{firm} fitted the {thing}, {firm} painted it.
Will call again on {day}.
Will be late, the {thing} is {quality}.
Mark the {thing} as {quality}.
Mark on the {thing}, {num} cm wide.
Hope this helps.
Hope to hear from you by {day}.
Grace period ends on {date}.
Bill attached, {money} in total.
Bill for the {thing} is {money}.
May we close this?
May {num} was a {day}.
June was dry, April was wet.
Rose bushes near the {thing} were cut down.
Frank talk about the {thing} helped.
Art class moved to {day}.
Young trees, long grass, green fields and a stone wall.
Stone steps lead to the {thing}.
Price list for {month}.
Cook for {num} minutes and drain.
Long wait at the {thing}.
White paint and brown tiles were used.
Wood floor in the hall, {quality} near the {thing}.
Banks were closed on {day}.
Ward {num} has no free beds.
Park and ride from {place}.
King size bed, {quality}.
Max load {num} kg.
Pat the surface dry with a towel.
Rich soil, sunny spot, ready by {month}.
Chase the supplier for the {thing}.
Skip hired until {day}.
Dean of the faculty signed the form.
Page {num} of {num}
Section {num} of form {form} deals with {thing}s.
Form {form} was sent on {date}.
Exclusion {code} applies.
See clause {num}, item {code}.
Does {code} exclude a {quality} {thing}?
Is a {quality} {thing} covered under {form}?
What does {form} say about the {thing}?
How long do we have to report a {quality} {thing}?
How much is payable for the {thing} after the deductible of {money}?
Which limit applies to the {thing} in {form}, {money} or {money}?
Can {form} and {form} apply at once?
Who pays for the {thing}?
Reserve set at {money}.
Payment of {money} issued on {date}.
Estimate of {money} for the {quality} {thing} approved.
Moisture at {num} percent near the {thing}, fans running.
Photos {num} to {num} show the {thing}.
Awaiting report on the {thing}.
No answer so far.
Awaiting documents, next review {date}.
Dehumidifier running, readings taken daily.
Roof tarp holds, no new leaks.
Storm on {date}, wind {num} mph at {place}.
Hail dents on the {thing}, gutters bent.
Ceiling wet, {thing} moved to storage.
Cause unknown, {thing} kept for testing.
Owner was away, {thing} froze.
Kitchen smoke damage only.
Basement flooded, {num} inches of water.
Lightning hit the {thing}.
Vandalism to the {thing} on {day} night.
Toilet overflowed upstairs.
Pipe burst behind the {thing}.
Thieves took the {thing} and {num} coins.
Replaced {num} way valve and {num} inch drive belt.
Installed {num} street lamps and a {num} court hall.
Room {num}, floor {num}, seat {num}.
Chapter {num}: The {thing}
Table {num} lists the {thing}s by year.
At {time} the {thing} stopped; at {time} it ran again.
{day}, {date}, {time}: nothing new.
Error {num} on line {num}: {thing} not found.
Return code {num}, retry in {num} s.
Die {ding} ist seit {date} defekt, {ding} folgt.
Der {ding} wurde am {date} gemeldet.
{ding} fehlt noch, bitte nachreichen.
{ding} und {ding} sind nass.
Bitte {ding} bis {date} prüfen.
Kein {ding} beschädigt, nur {ding}.
{ding} geprüft, alles trocken.
Neue {ding} bestellt, Kosten {money}.
Hat der {ding} Einfluss auf die {ding}?
Welche Frist gilt für {ding}?
Der Schaden wurde am {date} gemeldet.
Das Dach ist undicht, die Rechnung beträgt {money}.
Wasser im Keller, Pumpe läuft.
Termin am {date} um {time} Uhr bestätigt.
Unterlagen fehlen noch, Frist bis {date}.
La {chose} est en panne depuis le {date}.
Le {chose} a été remplacé le {date}.
{chose} et {chose} endommagés, photos à suivre.
Reçu le devis pour {chose}, {money}.
Eau dans la {chose}, rien dans le {chose}.
Pas de réponse concernant {chose}.
La garantie couvre-t-elle {chose} ?
Dossier complet, {chose} à vérifier.
Le sinistre a été déclaré le {date}.
Devis reçu, {money} pour le toit.
Dégât des eaux dans la cuisine.
Rendez-vous le {date} à {time}.
La {cosa} no funciona desde el {date}.
El {cosa} se cambió el {date}.
{cosa} y {cosa} dañados, faltan fotos.
Recibido el presupuesto de {cosa}, {money}.
Agua en la {cosa}, nada en el {cosa}.
Sin respuesta sobre {cosa}.
¿Cubre la póliza {cosa}?
Revisar {cosa} antes del {date}.
El siniestro se comunicó el {date}.
Daños por agua en la cocina y el pasillo.
Presupuesto recibido, {money}.
Fotos pendientes, plazo hasta {date}.
The committee meets on {day} at {time} in {place}.
Rent is {money}, due on the first of {month}.
Gas meter {ref}, electricity meter {ref}.
Delivery note {ref} for {num} boxes.
Warranty void after {year}.
Sales in {month} reached {money}.
Water the {thing} twice a week.
Heat to {num} degrees, stir, serve.
The court heard the case in {year}.
Scientists in {place} found {num} species.
The match ended {num} to {num}.
Same address as claim {ref}, separate event.
Emails about the {thing} keep bouncing.
Phone line dead, {thing} wet.
Rate of {money} per hour @ {num} hours.
Meet @ {time}, bring the {thing}.
""".strip().split("\n")
GERMAN_THINGS = "Heizung,Dach,Keller,Rechnung,Wasserschaden,Gutachten,Waschmaschine,Küche,Rohr,Fenster,Haustür,Garage,Versicherung,Unterlagen,Handwerker,Zahlung,Teppich,Decke,Wand,Pumpe,Sturm,Feuchtigkeit,Trocknung,Angebot,Kostenvoranschlag,Boden,Leitung,Spülmaschine,Schrank,Mieter,Vermieter,Antrag,Frist,Vertrag,Termin".split(",")
FRENCH_THINGS = "chaudière,toiture,facture,cuisine,fenêtre,porte d'entrée,cave,expertise,fuite,assurance,plafond,salle de bains,machine à laver,devis,réparation,canalisation,locataire,propriétaire,moquette,grange,voiture,serrure,cheminée,tempête,dossier".split(",")
SPANISH_THINGS = "caldera,tejado,factura,cocina,ventana,puerta,sótano,informe,fuga,póliza,techo,lavadora,presupuesto,reparación,tubería,inquilino,propietario,alfombra,garaje,coche,cerradura,chimenea,tormenta,expediente,baño".split(",")
ID_LABELS = {
    "ssn": ["SSN", "SSN:", "SSN #", "SSN is", "social security", "Social Security no.", "soc sec", "social security number", "social", "ITIN", "social:", "SS#"],
    "ni": ["NI number", "NINO", "national insurance", "National Insurance no.", "NI no", "NI"],
    "passport": ["passport", "Passport no.", "passport number", "pasaporte", "Reisepass", "passeport", "Passport:"],
    "licence": ["licence", "driver's license", "driving licence", "DL", "license no.", "Führerschein", "license", "DL#", "driver license", "permis"],
    "tax": ["tax ID", "tax number", "Steuer-ID", "TIN", "tax id", "Steuernummer", "numéro fiscal", "tax no."],
    "national": ["national ID", "DNI", "ID card", "identity card", "NIE", "Personalausweis", "carte d'identité", "ID", "CURP", "national id no.", "ID number"],
}
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
MONTHS = "January February March April May June July August September October November December".split()
DOMAINS = "mail gmail outlook yahoo office webpost inbox firm hotmail school uni corp posteo example test home claims clinic".split()
SUFFIXES = "com org net co.uk de fr es edu io info test example invalid".split()


def _half(items, part: int | None):
    """All of a list, or the rows of one of two parts: 0 two thirds, 1 the third left over."""
    items = list(items)
    return items if part is None else [x for i, x in enumerate(items) if (i % 3 == 2) == (part == 1)]


class Grammar:
    """Draws of texts and slots; the same for the same seed."""

    def __init__(self, seed: int, part: int | None = None):
        self.r = random.Random(seed)
        self.given_names, self.families, self.ends = (_half(x, part) for x in (GIVEN, FAMILY, NAME_ENDS))
        self.told, self.plain, self.does, self.reaches = (_half(x, part) for x in (TOLD, PLAIN, DOES, REACHES))
        self.onsets = _half(ONSETS, part)

    # ---- single words ----------------------------------------------------------------------

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def letters(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n))

    def coined(self) -> str:
        r = self.r
        word = r.choice(self.onsets) + r.choice(VOWELS) + (r.choice(CODAS) if r.random() < 0.5 else "")
        for _ in range(r.choice((0, 1, 1, 2))):
            word += r.choice(self.onsets).lower()[:1] + r.choice("aeiou") + (r.choice(CODAS) if r.random() < 0.3 else "")
        return word

    def family(self) -> str:
        r = self.r
        one = lambda: r.choice(self.families) if r.random() < 0.4 else self.coined() + (r.choice(self.ends) if r.random() < 0.7 else "")
        p = r.random()
        if p < 0.08:
            return f"{one()}-{one()}"
        return r.choice(PARTICLES) + one() if p < 0.2 else f"{one()} {one()}" if p < 0.24 else one()

    def first(self) -> str:
        r = self.r
        name = r.choice(self.given_names) if r.random() < 0.5 else self.coined() + r.choice(("", "", "a", "o", "e", "us", "ine"))
        return f"{name}-{r.choice(self.given_names)}" if r.random() < 0.04 else name

    # ---- items: what stands before (not part of it), the item ---------------------------------

    def name(self) -> tuple[str, str]:
        r, g, f = self.r, self.first(), self.family()
        initial, title, p = f"{self.letters(1)}.", "", r.random()
        if p < 0.36:
            text = f"{g} {f}"
        elif p < 0.43:
            text = f"{f.upper() if r.random() < 0.6 else f}, {g}"
        elif p < 0.49:
            text = f"{g} {initial if r.random() < 0.8 else initial[0]} {f}"
        elif p < 0.6:
            text = f"{initial} {f}" if r.random() < 0.8 else f"{initial}{self.letters(1)}. {f}"
        elif p < 0.75:
            text = g
        elif p < 0.83:
            text = f
        else:
            title, text = r.choice(TITLES) + " ", r.choice((f, f, f"{g} {f}", f"{initial} {f}"))
        q = r.random()
        if q < 0.08:
            text = text.upper()
        elif q < 0.22 and "," not in text:
            text, title = text.lower(), title.lower() if r.random() < 0.5 else title
        return title, text

    def initials(self) -> tuple[str, str]:
        return "", self.r.choice((".".join(self.letters(2)) + ".", ". ".join(self.letters(3)) + ".", self.letters(1) + "." + self.letters(1) + "."))

    def email(self) -> tuple[str, str]:
        r = self.r
        plain = lambda s: re.sub(r"[^a-z\-]", "", unicodedata.normalize("NFKD", s.lower()).encode("ascii", "ignore").decode())[:14] or "x"
        g, f = plain(self.first()), plain(self.family())
        local = r.choice((f"{g}.{f}", f"{g}.{f}", f"{g}{f}", f"{g[0]}{f}", f"{g}_{f}", f, g, f"{g[0]}.{f}", f"{f}.{g}", f"info-{f}")) + r.choice(("", "", "", "", str(r.randint(1, 99)), f"+{r.choice(('news', 'shop', 'home'))}{r.randint(1, 99)}", "_" + str(r.randint(1950, 2010))))
        text = f"{local}@{r.choice(DOMAINS) if r.random() < 0.6 else plain(self.coined())}.{r.choice(SUFFIXES)}"
        if r.random() < 0.12:
            text = text.replace("@", f"@{r.choice(('mail', 'post', 'claims', 'm'))}.")
        p = r.random()
        if p < 0.14:
            text = text.upper()
        elif p < 0.3:
            a, b = r.choice((("(", ")"), ("[", "]")))
            text = text.replace("@", f" {a}at{b} ")
            if r.random() < 0.6:
                head, mark, tail = text.rpartition(f"at{b} ")
                text = head + mark + tail.replace(".", f" {a}dot{b} ")
        return "", text

    def tel(self) -> tuple[str, str]:
        r, d = self.r, self.digits
        area = str(r.randint(200, 989))
        text = r.choice((
            f"({area}) {d(3)}-{d(4)}", f"{area}-{d(3)}-{d(4)}", f"{area}.{d(3)}.{d(4)}", f"{area} {d(3)} {d(4)}", f"{area}{d(7)}", f"{area}{d(7)}", f"{area}{d(7)}", f"+1 {area} {d(3)} {d(4)}", f"+1-{area}-{d(3)}-{d(4)}", f"1-{area}-{d(3)}-{d(4)}",
            f"+1 ({area}) {d(3)}-{d(4)}", f"({area}){d(3)}-{d(4)}", f"({area}) {d(3)} {d(2)} {d(2)}", f"{area}/{d(3)}-{d(4)}", f"001 {area} {d(3)} {d(4)}", f"001 {area}/{d(3)} {d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(4)} {d(6)}", f"0{d(3)} {d(3)} {d(4)}",
            f"+44 {d(4)} {d(6)}", f"+44 (0){d(2)} {d(4)} {d(4)}", f"+49 {d(3)} {d(7)}", f"+49 (0){d(2)} {d(5)} {d(3)}", f"0{d(3)}/{d(6)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}",
            f"+34 {d(3)} {d(3)} {d(3)}", f"{d(3)} {d(2)} {d(2)} {d(2)}", f"+{d(2)} {d(2)} {d(8)}", f"+{d(2)}{d(10)}", f"00{d(2)} {d(3)} {d(6)}", f"{d(3)}-{d(4)}", f"0{d(2)} {d(6)}",
        ))
        return r.choice(("", "", "", "", "tel ", "tel. ", "ph ", "phone ", "mob. ", "cell ", "☎ ", "📞", "T: ", "mobile: ", "landline ", "no. ")), text

    def id(self) -> tuple[str, str]:
        r, d, a = self.r, self.digits, self.letters
        kind = r.choice(("ssn", "ssn", "ssn", "ni", "passport", "passport", "licence", "licence", "tax", "national", "national"))
        text = r.choice({
            "ssn": (f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", d(9), d(9)),
            "ni": (f"{a(2)} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", f"{a(2)} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", f"{a(2)}{d(6)}{r.choice('ABCD')}"),
            "passport": (a(1) + d(8), a(2) + d(7), d(9), f"{a(1)}{d(2)}{a(1)}{d(2)}{a(1)}{d(2)}", a(2) + d(6)),
            "licence": (f"{a(1)}{d(3)}-{d(4)}-{d(4)}", a(1) + d(7), a(1) + d(12), f"{a(2)}-{d(2)}-{d(4)}", d(8), f"{a(5)}{d(6)}{a(2)}{d(1)}{a(2)}"),
            "tax": (f"{d(2)} {d(3)} {d(3)} {d(3)}", d(11), f"{d(2)}/{d(3)}/{d(5)}", f"9{d(2)}-{d(2)}-{d(4)}", d(10)),
            "national": (d(8) + a(1), f"{d(8)}-{a(1)}", f"{a(1)}{d(7)}{a(1)}", f"{a(1)}{d(2)}{a(1)}{d(2)}{a(1)}{d(2)}", f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", f"{a(4)}{d(6)}{a(6)}{d(2)}", d(12)),
        }[kind])
        if kind == "ssn" and "-" in text and r.random() < 0.15:
            return "", text
        return r.choice(ID_LABELS[kind]) + " ", text

    def addr(self) -> tuple[str, str]:
        r = self.r
        n, p = str(r.choice((r.randint(1, 99), r.randint(100, 999), r.randint(1000, 19999)))), r.random()
        n += r.choice("abcABC") if r.random() < 0.06 else ""
        made = lambda: self.coined() + r.choice(("", "", *self.ends))
        if p < 0.08:
            text = f"{r.choice(GERMAN_ROADS) if r.random() < 0.6 else made()}{r.choice(('straße', 'str.', 'weg', 'gasse', 'allee', 'platz', 'ring', 'ufer'))} {n}"
        elif p < 0.13:
            text = f"{r.choice(GERMAN_PLACES) if r.random() < 0.6 else r.choice(('Am ', 'Im ', 'An der ', 'Zum ')) + made()} {n}"
        elif p < 0.21:
            road = r.choice(FRENCH_ROADS) if r.random() < 0.6 else r.choice(("de ", "du ", "des ", "de la ", "")) + made() + r.choice(("", "", "-" + made()))
            text = f"{n}{r.choice(('', '', '', ' bis', ','))} {r.choice(('rue', 'avenue', 'boulevard', 'chemin', 'impasse', 'place', 'allée', 'quai', 'route'))} {road}"
        elif p < 0.29:
            road = r.choice(SPANISH_ROADS) if r.random() < 0.6 else r.choice(("", "de ", "del ", "de la ")) + made()
            text = f"{r.choice(('Calle', 'calle', 'Avenida', 'Plaza', 'Paseo', 'Camino', 'C/', 'Av.', 'Carretera', 'Ronda', 'Avda.'))} {road}{r.choice((' ', ' ', ' ', ', '))}{n}"
        elif p < 0.32:
            text = f"{r.choice(('Via', 'Viale', 'Piazza', 'Corso'))} {r.choice(ITALIAN_ROADS) if r.random() < 0.6 else made()} {n}"
        else:
            way = r.choice(WAYS)
            way += "." if way in ABBREVIATED and r.random() < 0.3 else ""
            side = r.choice(("N", "S", "W", "E", "N.", "S.", "W.", "E.", "North", "South", "West", "East", "NW", "SE")) + " " if r.random() < 0.18 else ""
            road = r.choice(ROADS) if r.random() < 0.45 else made() + (f" {r.choice(ROADS)}" if r.random() < 0.2 else "")
            text = f"{n} {side}{road}{'' if r.random() < 0.01 else ' ' + way}"
        case = r.random()
        text = text.upper() if case < 0.08 else text.lower() if case < 0.2 else text
        return r.choice(("Apt", "Unit", "Flat", "Suite", "Apartment", "unit", "flat")) + f" {r.randint(1, 60)}{r.choice(('', '', 'B'))}, " if r.random() < 0.08 else "", text

    # ---- look-alikes -------------------------------------------------------------------------

    def other(self, slot: str) -> str:
        r, d = self.r, self.digits
        if slot == "thing":
            return r.choice(THINGS)
        if slot == "quality":
            return r.choice(QUALITIES)
        if slot == "firm":
            head = r.choice(FIRM_HEADS) if r.random() < 0.6 else r.choice((self.coined(), r.choice(self.families), r.choice(ROADS)))
            return f"{head} {r.choice(FIRM_TAILS)}"
        if slot == "place":
            return r.choice(PLACES) if r.random() < 0.6 else r.choice(("", "", "", "Lake ", "Mount ", "Port ", "North ", "Upper ")) + self.coined() + r.choice(("", *self.ends)) + r.choice(("", "", "", " Creek", " Valley", " County", " Heights"))
        if slot == "street":
            return f"{r.choice(ROADS) if r.random() < 0.6 else self.coined() + r.choice(('', *self.ends))} {r.choice(WAYS)}"
        if slot == "num":
            return d(r.choice((1, 1, 2, 2, 3, 4, 6))).lstrip("0") or "8"
        if slot == "money":
            return r.choice((f"{r.randint(1, 99)},{d(3)}", f"${r.randint(10, 9999)}", f"{r.randint(10, 900)}.{d(2)}", f"USD {r.randint(1, 90)},{d(3)}", f"€{r.randint(5, 500)}", f"{r.randint(1, 99)}00", f"{r.randint(1, 20)} 000 EUR"))
        if slot == "date":
            y, m, k = 2000 + r.randint(0, 29), r.randint(1, 12), r.randint(1, 28)
            return r.choice((f"{y}-{m:02}-{k:02}", f"{y}-{m:02}-{k:02}", f"{m}/{k}/{y}", f"{k:02}.{m:02}.{y}", f"{k} {MONTHS[m - 1]} {y}", f"{MONTHS[m - 1]} {k}", f"{k} {MONTHS[m - 1][:3]} {y}", f"{y}/{m:02}/{k:02}", f"{y}{m:02}{k:02}"))
        if slot == "ref":
            return r.choice((f"{self.letters(3)}-{r.randint(2015, 2029)}-{d(8)}", f"{self.letters(2)}-{d(6)}", f"{d(4)}-{d(4)}-{d(2)}", f"{d(5)}-{d(3)}", f"INV{d(6)}", f"{self.letters(1)}-{d(8)}", d(7), d(6), f"SN{d(9)}", f"{self.letters(2)}{d(8)}", f"{d(2)}-{d(6)}", f"{d(3)}/{d(5)}", f"{self.letters(4)}-{d(4)}-{d(4)}", d(12)))
        return {
            "ding": lambda: r.choice(GERMAN_THINGS),
            "chose": lambda: r.choice(FRENCH_THINGS),
            "cosa": lambda: r.choice(SPANISH_THINGS),
            "day": lambda: r.choice(DAYS),
            "month": lambda: r.choice(MONTHS),
            "year": lambda: str(r.randint(1850, 2029)),
            "time": lambda: f"{r.randint(0, 23)}:{r.randint(0, 59):02}",
            "code": lambda: f"{self.letters(1)}-{d(2)}",
            "form": lambda: f"{self.letters(2)}-{d(4)}" + r.choice(("", "", "", " ed. 01-24")),
            "does": lambda: r.choice(self.does),
        }[slot]()


_SLOT = re.compile(r"\{(\w+)\}")
_KIND = {"name": "name", "initials": "name", "email": "email", "tel": "phone", "id": "id_number", "addr": "address"}
Row = tuple[str, list[tuple[int, int, str]]]


def _filled(g: Grammar, pattern: str, text: str, items: list[tuple[int, int, str]]) -> str:
    """``text`` with the pattern after it; its items are added to ``items``."""
    at = 0
    for m in _SLOT.finditer(pattern):
        text, at, slot = text + pattern[at : m.start()], m.end(), m.group(1)
        if slot in _KIND:
            before, item = getattr(g, slot)()
            items.append((len(text) + len(before), len(text) + len(before) + len(item), _KIND[slot]))
            text += before + item
        else:
            value = g.other(slot)
            text = _filled(g, value, text, items) if slot == "does" else text + value
    return text + pattern[at:]


def _pattern(g: Grammar) -> str:
    """One sentence's pattern: somebody does something, is reached, a set phrase, or nothing personal."""
    r, p = g.r, g.r.random()
    who = lambda: r.choice(("{name}", "{name}", "{name}", "{name}", "{name}", "{firm}", r.choice(ROLES), r.choice(BARE)))
    if p < 0.2:
        s = who()
        return (s[:1].upper() + s[1:] if r.random() < 0.8 and s[0] != "{" else s) + " " + r.choice(g.does) + r.choice((".", ".", ".", "", ";", "!"))
    if p < 0.42:
        s = r.choice(g.reaches)
        s = s if r.random() < 0.8 else s[:1].lower() + s[1:]
        s = s.replace("{x}", who() if r.random() < 0.85 else f"{who()} and {who()}")
        more = r.random()
        if more < 0.25:
            s += r.choice((", who ", " - ", "; ", ": ", ", ")) + r.choice(g.does)
        elif more < 0.4:
            s += r.choice((" at {tel}", " on {tel}", ", {tel}", " ({tel})", " ({id})", ", {addr}", " at {addr}", ", {email}", " about the {thing}", " re the {quality} {thing}", " of {addr}", " of {firm}", " on {date}", " in {place}"))
        return s + r.choice((".", ".", "", "", "!", "?"))
    return r.choice(g.told) if p < 0.72 else r.choice(g.plain)


def labelled_table(size: int = 16_000, seed: int = 11, part: int | None = None) -> list[Row]:
    """``size`` texts of one to three sentences with their items as (start, end, kind); the same
    for the same seed.  ``part`` 0 or 1 draws from two sets of phrases and names without overlap."""
    g, rows = Grammar(seed, part), []
    r = g.r
    for _ in range(size):
        text, items = "", []
        if r.random() < 0.3:
            text = r.choice(("{date} ", "{date}: ", "{time} ", "- ", "* ", "Note: ", "Re: ", "FYI ", "Update {date}. ", "{day}: ", "> ", "({num}) "))
            text = _filled(g, text, "", items)
        for k in range(r.choice((1, 1, 1, 2, 2, 3))):
            text = _filled(g, _pattern(g), text + (r.choice((" ", " ", " ", "  ", "\n")) if k else ""), items)
        if r.random() < 0.03 and not any(kind == "email" for _, _, kind in items) and len(text.upper()) == len(text):
            text = text.upper()
        rows.append((text, items))
    return rows
