"""Common short forms of given names, by the full name they stand for."""

SHORT_FORMS = {
    "alexander": "alex sasha sandy xander lex", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny", "catherine": "cathy cate", "charles": "charlie chuck",
    "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davy", "deborah": "debbie deb debra", "dmitri": "dima mitya", "dorothy": "dot dotty",
    "edward": "ed eddie ned", "ekaterina": "katya katia", "elizabeth": "liz beth eliza betty lizzie lisa", "ferdinand": "ferdi", "francis": "frank",
    "francisco": "paco pancho cisco", "frederick": "fred freddie", "gabriela": "gabi gaby", "gabriel": "gabe", "george": "georgie", "giuseppe": "beppe peppe", "gregory": "greg",
    "henrietta": "etta hettie", "henry": "harry hank", "isabella": "bella isa izzy", "ivan": "vanya", "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jen jenny",
    "johannes": "hannes hans", "john": "jack johnny", "jonathan": "jon", "joseph": "joe joey", "josephine": "jo josie", "joshua": "josh", "judith": "judy", "katherine": "kate kathy katie",
    "kenneth": "ken kenny", "lawrence": "larry", "leonard": "len lenny", "leonardo": "leo", "lucia": "lucy luce", "margaret": "peggy maggie meg marge", "maria": "mia",
    "matthew": "matt", "michael": "mike mick mikey", "mikhail": "misha", "nathaniel": "nate nat", "nathan": "nath", "nicholas": "nick nicky", "nikolai": "kolya", "patricia": "pat patty trish",
    "patrick": "paddy", "pavel": "pasha", "peter": "pete", "philip": "phil", "rebecca": "becky becca", "richard": "rick dick rich", "robert": "bob rob bobby", "ronald": "ron",
    "samuel": "sam sammy", "samantha": "sammie", "stephen": "steve", "steven": "stevie", "susan": "sue susie", "theodore": "theo ted teddy", "thomas": "tom tommy", "timothy": "tim",
    "tomoko": "tomo", "victoria": "vicky tori", "victor": "vic", "vladimir": "vova volodya", "william": "bill will billy", "wilhelm": "willi", "yusuf": "yus", "zachary": "zach zack",
}
FULL = {s: full for full, shorts in SHORT_FORMS.items() for s in shorts.split()}
