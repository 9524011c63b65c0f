"""A small labelled table for the sequence model: fixed values, written for this library.

Personal data stands in braces with its kind. Lines without braces show what must stay unmarked.
"""

EXAMPLES = (
    "please write to {email:anna.meier@mail.example.com} before noon",
    "her address is {email:j_doe77@corp.example.org} and she answers fast",
    "contact {email:sales@shop.example.net}, thank you",
    "mail me: {email:bob [at] example [dot] com} for the files",
    "write {email:carla (at) mail (dot) example (dot) org} today",
    "send it to {email:info [at] example.net} please",
    "reach {email:d.lopez (at) example.com} or wait",
    "email {email:erik dot berg at example dot com} with questions",
    "my mail is {email:f at example dot org} since may",
    "questions to {email:gina [at] example [dot] org} by friday",
    "my address: {email:h.wolf [at] mail.example.com}",
    "{email:ines (at) example (dot) net} has the keys",
    "ask {email:jan (at) shop.example.org} about it",
    "write me at {email:kim at example dot net} soon",
    "{email:lea dot park at mail dot example dot com} works too",
    "ping {email:moe at corp dot example dot org} please",
    "call {phone:+1 415 555 0199} after six",
    "or call {phone:415-555-0102} before nine",
    "my cell is {phone:646-555-0171} again",
    "{phone:312-555-0129} is the desk",
    "office {phone:(312) 555-0148} or home",
    "try {phone:(0221) 555 017} instead",
    "number {phone:(415) 555 0133}, ask for bo",
    "text {phone:202.555.0113} any time",
    "home {phone:0044 20 7946 0111} only",
    "cell {phone:0151 555 01234} abends",
    "{phone:0800 555 0190} is free of charge",
    "phone {phone:+49 30 1234567} in the office",
    "tel {phone:(212) 555-0143} ask for the desk",
    "ring me at {phone:212-555-0187} tomorrow",
    "mobile {phone:555-867-5309} or text",
    "fax {phone:020 7946 0958} in london",
    "call {phone:(030) 901 820} now",
    "phone: {phone:415.555.0121} all day",
    "tel. {phone:0170 555 0133} bitte",
    "the number is {phone:(646) 555-0110}.",
    "dial {phone:001 212 555 0166} from abroad",
    "paid with card {card:4111 1111 1111 1111} yesterday",
    "card {card:5500-0000-0000-0004} expires soon",
    "card no. {card:4012.8888.8888.1881} was used",
    "visa {card:4222/2222/2222/2220} on file",
    "charge {card:4111.1111.1111.1111} please",
    "my visa is {card:4111-1111-1111-1111} ok",
    "use {card:5105.1051.0510.5100} for this",
    "mastercard {card:5555/5555/5555/4444} declined",
    "card {card:4000.0000.0000.0002} lost",
    "the host {ip:192.0.2.17} was down",
    "{ip:198[.]51[.]100[.]7} is a known scanner",
    "traffic from {ip:203[.]0[.]113[.]8} stopped",
    "blocked {ip:192 [.] 0 [.] 2 [.] 44} today",
    "host {ip:198 [.] 51 [.] 100 [.] 9} again",
    "ip {ip:203.0.113.9} blocked",
    "from {ip:198[.]51[.]100[.]23} we saw scans",
    "server {ip:192[.]0[.]2[.]1} is back",
    "ping {ip:203 [.] 0 [.] 113 [.] 77} again",
    "the meeting is at 10 in room 12",
    "version 2.0 of the license applies",
    "licensed under version 3.0, see section 4.2.1",
    "in 2019 there were 1200 people in the town",
    "on 2021-05-17 the shop opened",
    "between 1914 and 1918 the war went on",
    "it costs 19.99 or 25.00 with tax",
    "see pages 12-15 and 101-110",
    "the ratio was 3.1415 in the first run",
    "chapter 7 (see 7.1) explains it",
    "we are at home and the dog is at the door",
    "he was at the market at noon",
    "put a dot at the end",
    "the order 20210517 shipped",
    "token = 9f86d081884c7d659a2feaa0c55ad015",
    "isbn 978-3-16-148410-0 is out of print",
    "a score of 3-2 after 90 minutes",
    "the key 4435629012345678901234 is a checksum",
    "at 14:30 on 3/4/2020 it rained",
    "build 10.2 (3301) came out in 2020",
    "lines 100 200 300 400 are blank",
    "there are 1 000 000 stars",
    "the tag @home is used here",
    "use x@y in the formula",
    "article 5 (2) of 1998",
    "from 100 to 200 units at 5 percent",
    "room 101 (floor 1) at 9",
    "(c) 2004-2006 by the authors",
    "[1] [2] [3] are the sources",
    "in 12.5 percent of 300 cases",
)
