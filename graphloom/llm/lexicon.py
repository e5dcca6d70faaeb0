"""Word classes and labelled phrase patterns for the abuse classifier.

Offensive words are listed because a detector has to know them. Everything here is general
knowledge of four languages: ordinary dictionary words by class, and short phrases built
from them by slots. None of it is taken from any corpus; a test holds the phrases against
the supplied documents and fails if one occurs there. What is special to a corpus has to
come from its reviews.
"""

#: Usual words of English, German, French and Spanish in plain spelling.
CLASSES = {
    "YOU": """you your yours yourself u ur youre youll ya thou du dich dir dein deine deinen deiner ihr euch euer tu te toi
        ton ta tes vous votre vos ti tuyo usted ustedes eres""",
    "SELF": "i me my mine myself im ive ill we our us ourselves ich mich mir mein meine wir uns je moi mon mes nous yo mi mis",
    "INSULT": """idiot moron imbecile cretin dumbass jackass asshole arsehole bastard bitch scumbag scum loser clown halfwit
        dimwit nitwit fool jerk dickhead prick wanker twat cunt slut whore coward retard psycho swine creep maggot pig
        troll liar degenerate trash garbage douchebag douche shithead simpleton dunce dolt oaf buffoon dope dork blockhead
        numbskull airhead lowlife vermin parasite leech worm rat snake cockroach weasel slob freak weirdo crybaby snowflake
        motherfucker tosser git muppet bellend plonker pillock idiotin vollidiot trottel depp arschloch drecksack versager
        wichser hurensohn missgeburt schlampe dummkopf penner abschaum schwein drecksau spast mistkerl idiote connard
        connasse abruti imbecile salaud salope enfoire batard ordure debile bouffon raclure encule cretin idiota imbecil
        gilipollas cabron basura payaso puta hijoputa pendejo escoria mierdoso tarado subnormal estupida""",
    "DEROG": """stupid dumb pathetic brainless worthless useless filthy ugly miserable spineless retarded disgusting rotten
        fucking bloody damn lousy gutless clueless mindless vile nasty fat smelly incompetent hopeless ridiculous repulsive
        inferior laughable moronic idiotic dumm nutzlos erbarmlich hasslich dreckig widerlich blod verdammt armselig
        pauvre nul stupide sale inutile degoutant minable moche estupido inutil asqueroso tonto ridiculo feo patetico""",
    "GROUP": """women woman men girls immigrants immigrant refugees refugee foreigners foreigner migrants migrant gays
        gay lesbians lesbian homosexuals trans transgender jews jew muslims muslim christians hindus blacks whites asians
        mexicans africans arabs gypsies elderly disabled cripples faith religion race ethnicity nationality auslander
        fluchtlinge frauen juden muslime schwule lesben etrangers immigres femmes juifs musulmans refugies noirs arabes
        extranjeros inmigrantes mujeres judios musulmanes refugiados negros gitanos""",
    "DEHUM": """vermin rats cockroaches roaches plague pest disease cancer breed breeding subhuman animals parasites infest
        infestation inferior deport deported exterminate exterminated invaders savages criminals thieves rapists
        terrorists ungeziefer pest ratten parasiten untermenschen abschieben racaille peste cafards sauvages plaga escoria
        ratas cucarachas salvajes""",
    "SEX": """nude nudes naked porn porno xxx sex sexy blowjob horny moan moaning lap panties bra undress cock dick pussy
        tits boobs ass cum cumming cam cams camgirl orgasm masturbate masturbating stripper escort escorts erotic fetish
        kinky hookup milf threesome anal oral thighs nipples nacktfotos nackt geil titten ficken nu nue nues sexe baise
        seins nichons desnuda desnudas desnudo sexo follar tetas polla""",
    "HARM": """kill killed killing die dies dying dead death murder murdered stab stabbed shoot shot burn burned hospital
        knife bullet skull throat neck strangle strangled hang hanged rope lynch drown drowned grave bury buried punch
        beat beaten smash hurt bleed bleeding suffer cripple crippled torture tortured rape raped suicide cancer
        umbringen umgebracht toten getotet sterben stirb verrecken erschiessen erschossen schlagen verprugeln tuer tue
        creve crever mourir meurs frapper egorger matar mato morir muere muerto golpear degollar""",
    "BODY": """face teeth jaw bones legs arms fingers nose head brain blood mouth eyes fresse zahne knochen kopf schadel
        gueule dents tete os cara dientes huesos cabeza boca""",
    "CURSE": """fuck fucked shit shitty crap hell damn merde mierda scheisse scheiss mist putain joder sacre verdammt hostia
        bordel coño""",
    "RULE": """removed remove removes rule rules policy filter filters conduct blocklist blacklist wordlist banned ban
        moderation moderator moderators flag flagged flags profanity slur slurs words list hide hidden report reported
        reports contains reject rejects rejected regeln regel filtert entfernen entfernt gesperrt supprime supprimes
        filtre reglement interdit borran borra reglas regla filtro prohibido""",
    "TECH": """process thread child parent server domain test collector node signal daemon job worker cache branch code
        file function method class module script build commit merge parser query index patch release bug error message
        proceso hijo processus enfant kindprozess elternprozess prozess naming master slave replica endpoint operator
        memory schema table column key value string loop compiler token request response""",
    "WARM": """thanks thank please great nice welcome friend love congrats congratulations well good sorry appreciate
        appreciated awesome danke bitte merci gracias""",
}

#: Identity terms that are exchanged for each other, of each language.
IDENTITY = {
    "en": ["women", "men", "immigrants", "refugees", "foreigners", "jews", "muslims", "christians", "asians", "africans",
           "mexicans", "gays", "lesbians", "migrants", "hindus"],
    "de": ["Ausländer", "Flüchtlinge", "Frauen", "Juden", "Muslime", "Schwule"],
    "fr": ["étrangers", "immigrés", "femmes", "juifs", "musulmans", "réfugiés"],
    "es": ["extranjeros", "inmigrantes", "mujeres", "judíos", "musulmanes", "refugiados"],
}

SLOTS = {
    "ins": """idiot moron imbecile cretin dumbass jackass asshole bastard bitch scumbag loser clown halfwit dimwit fool jerk
        dickhead prick wanker coward retard creep pig liar parasite worm rat degenerate dunce""".split(),
    "inss": "idiots morons imbeciles assholes bastards losers clowns fools jerks cowards pigs liars parasites".split(),
    "adj": """stupid dumb pathetic brainless worthless useless filthy ugly miserable spineless fucking disgusting rotten
        clueless lousy retarded""".split(),
    "harm": "kill hurt stab shoot strangle beat punch burn hang murder drown cripple".split(),
    "harmed": "killed hurt stabbed shot strangled beaten punched burned hanged murdered drowned".split(),
    "body": "face teeth jaw bones legs nose skull neck".split(),
    "dehum": "vermin parasites animals rats cockroaches subhuman savages criminals thieves cancer filth".split(),
    "sx": "tits ass pussy cock dick boobs".split(),
    "porn": "porn xxx sex nude naked erotic".split(),
    "thing": "parser cache build commit script test query graph patch module release index schema server branch loader".split(),
    "verb": "merge sort scan write review resolve push index split read parse".split(),
    "who": "he she they alex sam the_author the_maintainer that_guy".replace("_", "-").split(),
    "dins": "Idiot Vollidiot Trottel Depp Arschloch Drecksack Versager Wichser Hurensohn".split(),
    "fins": "connard crétin abruti imbécile minable débile salaud enfoiré".split(),
    "sins": "imbécil idiota gilipollas payaso inútil basura cabrón pendejo".split(),
}

#: A person is insulted, threatened or wished harm.
ABUSIVE = """
you {ins}
you {adj} {ins}
you are {adj}
you are a {ins}
you're such a {ins}
you're a {adj} {adj} {ins}
you absolute {ins}
you complete and utter {ins}
{who} is {adj}
{who} is a {ins}
{who} is a {adj} {ins}
{who} is such a {ins}
bunch of {inss}
you {inss}
you're all {inss}
they are {adj} {inss}
hey {ins}
{adj} {ins}
look at this {adj} {ins}
what an {ins}
listen you {ins}
ignore that {ins}
fire that {ins}
stfu {ins}
gtfo {ins}
fuck you
fuck off {ins}
screw you {ins}
piss off {ins}
eat shit {ins}
suck it {ins}
kys
just {harm} yourself
please die
drop dead {ins}
rot in hell
burn in hell
i hate you
i despise you {who}
i'll {harm} you
i will {harm} you
i'm going to {harm} you
gonna {harm} you
we will {harm} your family
i'll {harm} you in your sleep
i'll smash your {body}
i'll break your {body}
i'll kick your {body} in
wanna {harm} {who}
someone {harm} {who}
you should be {harmed}
you will be {harmed}
{who} should be {harmed}
{who} deserves to be {harmed}
hope you get {harmed}
hope {who} dies
wish you were dead
you're dead meat
your {body} is {adj}
your ugly {body}
your {adj} {body}
your mom is a {ins}
your {adj} mother
no brain {ins}
braindead {ins}
brain of a {ins}
smells like a {ins}
waste of skin
waste of air
you make me puke
nobody wants you, {ins}
too {adj} to breathe
you're {adj} and you know it
"""

ABUSIVE_OTHER = """
du {dins}
du bist ein {dins}
du bist so dumm
ihr seid alle {dins}en
so ein {dins}
er ist ein {dins}
dieser {dins}
du dumme Sau
fick dich
leck mich, {dins}
Fresse, {dins}
ich bring dich um
ich mach dich kalt
ich schlage dich tot
ich stech dich ab
man sollte dich erschießen
stirb, {dins}
verrecke
hoffentlich stirbst du
du bist hässlich
dein hässliches Gesicht
tu es un {fins}
espèce de {fins}
sale {fins}
quel {fins}
c'est un {fins}
pauvre {fins}
bande de {fins}s
nique ta mère
va crever
je vais te tuer
je vais te frapper
je te casse la gueule
tu vas mourir
tu mérites de mourir
ton sale visage
tu es moche
eres {sins}
eres un {sins}
pedazo de {sins}
maldito {sins}
es un {sins}
qué {sins}
hijo de puta
puto {sins}
te voy a golpear
voy a matarte
te rompo los huesos
muérete, {sins}
mereces morir
das asco
eres feo
tu cara de {sins}
"""

#: A group of people is degraded or attacked.
HATEFUL = """
{group} are {dehum}
{group} are {adj}
all {group} are {dehum}
all {group} are {adj}
{group} are all {inss}
{adj} {group}
those {adj} {group}
{group} should be {harmed}
{harm} all {group}
{group} must die
death to {group}
exterminate {group}
deport {group}
ban {group} from everything
i despise {group}
i can't stand {group}
{group} disgust me
{group} smell
{group} steal
{group} are inferior
{group} have no brains
never hire {group}
never trust {group}
don't trust {group}
keep {group} away
kick {group} out
{group} out
{group} go home
no {group} allowed
{group} belong in the kitchen
{group} belong in cages
too many {group}
damn {group}
fucking {group}
hang the {group}
"""

HATEFUL_OTHER = """
de|{group} sind Ungeziefer
de|{group} sind Parasiten
de|{group} sind dumm
de|alle {group} sind dreckig
de|scheiß {group}
de|{group} stinken
de|ich hasse {group}
de|{group} abschieben
fr|les {group} sont des parasites
fr|sales {group}
fr|les {group} sont inférieurs
fr|je hais les {group}
fr|mort aux {group}
fr|les {group} puent
es|los {group} son parásitos
es|los {group} son inferiores
es|odio a los {group}
es|malditos {group}
es|muerte a los {group}
es|{group} apestan
"""

#: Sexually explicit talk, solicitation or advertising.
SEXUAL = """
send nudes
show me your {sx}
nice {sx}
suck my {sx}
lick my {sx}
touch your {sx}
your {sx} in my mouth
i'm so horny
so horny for you
i want to fuck you
let me fuck you
fuck me harder
wanna have sex
have sex with me
want sex tonight
{porn} videos
{porn} pics
{porn} chat
{porn} girls
free {porn} site
hot {porn} cams
watch {porn}
sexy singles
escort girls
call girls
my {sx} is hard
her wet {sx}
cum on my face
he came inside her
she took off her bra
rub my {sx}
big {sx}
get naked for me
take your clothes off
masturbate for me
zeig mir deine Titten
ich bin so geil
fick mich
nackte Weiber
Sex heute Nacht
montre tes seins
baise-moi
vidéos porno
envie de sexe
enséñame las tetas
fóllame
vídeos porno
quiero sexo
"""

#: Technical senses, swearing at things or oneself, friendly remarks, rules that name such words.
CLEAN = """
kill the process
kill the {thing}
the {thing} gets killed
{thing} killed by signal
the child process died
children of a dead parent
orphan and zombie processes
dead code in the {thing}
dead lock in the {thing}
execute the {thing}
abort the {thing}
hang in the {thing}
the {thing} hangs
the {thing} crashed and burned
kill switch for the {thing}
master and slave {thing}
the slave {thing}
garbage collection of the {thing}
garbage in the {thing}
strip the {thing}
naked {thing}
dumb terminal
dumb {thing}
dummy {thing}
stupid {thing}
this stupid {thing}
ugly {thing}
the {thing} is ugly
the {thing} is useless
this {thing} is crap
this {thing} sucks
what a crappy {thing}
the {thing} is a mess
shitty {thing}
fucking {thing}
this damn {thing}
i hate this {thing}
damn it
oh shit
wtf is this {thing}
what the hell
holy crap
i'm an {ins}
i'm such a {ins}
i was {adj}
silly me
stupid mistake of mine
my {adj} mistake
sorry, my fault
you rock
you're awesome
you beast, well done
killer {thing}
badass {thing}
insanely good {thing}
the word {ins} is flagged
words like {ins} are filtered
"{ins}" is on the list
the filter rejects {ins}
insults such as {ins} are banned
calling people {ins} is not allowed
no slurs, no threats
rules against insults and threats
messages with {porn} links get removed
{porn} spam is deleted by the filter
the {porn} filter
comments with {ins} are hidden
{group} can use the {thing}
{group} and {group2}
{group} were asked about the {thing}
{group} in the data set
the number of {group}
support for {group}
{group} are welcome
a word about {group}
more {group} in tech
{group} wrote the {thing}
interviews with {group}
you can {verb} the {thing}
please {verb} the {thing}
your {thing} is slow
your {thing} needs a test
you broke the {thing}
your {thing} is wrong
you are right
you are welcome
are you sure about the {thing}
i will {verb} the {thing}
i'll fix the {thing}
i will find it
{who} is right
{who} wrote the {thing}
{who} is on holiday
{verb} the {thing}
{verb} the {thing} and the {thing}
add a {thing}
remove the {thing}
call the {thing}
call it here
use the {thing}
see the {thing} there
the {thing} is slow
the {thing} and the {thing}
{thing} of the {thing}
return {thing}
break
continue
exit
default
die
null
"""

CLEAN_OTHER = """
den Prozess beenden
der Prozess stirbt
Kindprozess abschießen
der {thing} ist Mist
blöder {thing}
so ein Scheiß
ich Idiot
ich bin so blöd
Wörter wie {dins} sind gesperrt
der Filter kennt {dins}
danke, super gemacht
der {thing} ist langsam
wir sollten den {thing} ändern
arrêter le processus
le processus meurt
quel {thing} pourri
putain de {thing}
quel con je suis
je suis bête
le filtre bloque {fins}
merci, beau travail
le {thing} est lent
il faut changer le {thing}
parar el proceso
el proceso muere
qué asco de {thing}
este {thing} es una mierda
qué tonto soy
soy idiota
el filtro bloquea {sins}
gracias, buen trabajo
el {thing} es lento
hay que cambiar el {thing}
de|{group} und andere
de|viele {group} nutzen das
fr|les {group} et les autres
fr|beaucoup de {group}
es|los {group} y otros
es|muchos {group} lo usan
"""
