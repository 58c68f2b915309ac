"""Short forms of given names, titles and other words that stand beside names."""

from __future__ import annotations

# Given names of several languages, each with its usual short forms. What is no short form of another name needs no entry.
SHORT_FORMS = {
    "abigail": "abby abbie gail",
    "alexander": "alex alec sasha xander sandy",
    "benjamin": "ben benji benny",
    "charlotte": "lottie charlie lotte",
    "cornelius": "cor neil connie",
    "daniel": "dan danny",
    "dorothea": "dora dot dottie thea",
    "eduardo": "edu lalo eddie",
    "elizabeth": "liz lizzie beth betty eliza lisa",
    "fernando": "nando fer",
    "francesca": "fran frankie cesca",
    "gabriel": "gabe",
    "gwendolyn": "gwen wendy",
    "heinrich": "heinz heini heiner",
    "henrietta": "hattie etta hetty",
    "ignatius": "iggy nacho ignaz",
    "isabella": "bella izzy isa",
    "jacqueline": "jackie jacqui",
    "jonathan": "jon jonny nathan",
    "katherine": "kate kathy katie kat kitty",
    "lawrence": "larry laurie lars",
    "leonardo": "leo nardo",
    "margaret": "maggie meg peg peggy greta madge",
    "matilda": "tilly mattie tilda",
    "nicholas": "nick nico nicky klaus",
    "oliver": "ollie olly",
    "ottilie": "otti tilli",
    "patricia": "pat trish patty tricia",
    "penelope": "penny nell",
    "quentin": "quin quent",
    "robert": "bob rob bobby robbie",
    "rosalind": "roz rosie linda",
    "samantha": "sam sammy",
    "sebastian": "seb bastian basti",
    "theodore": "ted theo teddy",
    "timothy": "tim timmy",
    "ursula": "ulla uschi",
    "victoria": "vicky tori vic",
    "vincent": "vinnie vince",
    "wilhelmina": "mina willa minnie",
    "william": "bill will liam billy willy",
    "yolanda": "yoli yola",
    "yusuf": "yus joseph",
    "zachary": "zach zack",
    "james": "jim jimmy",
    "thomas": "tom tommy",
    "richard": "dick rick",
    "michael": "mike",
    "anna": "annie",
    "andrew": "andy drew",
    "anthony": "tony",
    "barbara": "barb babs",
    "caroline": "carrie lina",
    "christopher": "chris kit topher",
    "deborah": "deb debbie",
    "edward": "ed ned eddy",
    "frederick": "fred freddie fritz",
    "gregory": "greg",
    "jennifer": "jen jenny",
    "joshua": "josh",
    "kenneth": "ken kenny",
    "matthew": "matt",
    "nathaniel": "nate nat",
    "pamela": "pam",
    "peter": "pete petey",
    "philip": "phil pip",
    "raymond": "ray",
    "rebecca": "becky becca",
    "ronald": "ron ronnie",
    "samuel": "sam sammy",
    "stephen": "steve stevie",
    "susan": "sue susie",
    "francisco": "paco pancho curro",
    "guadalupe": "lupe lupita",
    "guillermo": "memo guille",
    "ignacio": "nacho",
    "consuelo": "chelo",
    "dolores": "lola",
    "mercedes": "merche",
    "enrique": "quique kike",
    "johannes": "hans hannes jo",
    "friedrich": "fritz friedel",
    "magdalena": "lena magda",
    "aleksandr": "sasha alik",
    "dmitri": "dima mitya",
    "mikhail": "misha",
    "yekaterina": "katya",
    "anastasia": "nastya stasia",
    "katarzyna": "kasia",
    "malgorzata": "gosia",
    "giuseppe": "beppe peppe pino",
    "giovanni": "gianni nino",
    "abdelkader": "kader",
}

#: A given name or short form -> the given names it may stand for.
FORMAL: dict[str, tuple[str, ...]] = {}
for _name, _short in SHORT_FORMS.items():
    for _form in (_name, *_short.split()):
        FORMAL[_form] = (*FORMAL.get(_form, ()), _name)

#: Short forms that are also everyday words: names only where they are written with a capital.
EVERYDAY = frozenset("pat dot peg will bill rob penny sandy rosie kitty bob dan meg nick cor edu dick bella rick kat quin fer gail tim sam vic ted".split())

TITLES = ("dr", "mr", "mrs", "ms", "miss", "prof", "professor", "doctor", "sir", "madam", "rev", "herr", "frau", "señor", "señora", "sr", "sra", "mme", "mlle", "monsieur", "madame", "coach", "captain", "judge", "nurse", "uncle", "aunt")

#: Words that follow a name or an initial but are no surname.
NOT_SURNAMES = frozenset(
    "the and for was has had his her not but you they this that with from will who whose would could should must may might can are were our your its she him there here when where what which "
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday "
    "januar februar marz april mai juni juli august september oktober november dezember montag dienstag mittwoch donnerstag freitag samstag sonntag "
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre janvier fevrier mars avril juin juillet aout decembre "
    "street road avenue lane close crescent row street's notes says said asked told wrote called keeps gave owes phone tel mail email order ticket please thanks thank sure before after "
    "und oder der die das ist mit von für auf nicht schreiben et est avec pour dans les des une qui que para con por los las una del".split()
)
