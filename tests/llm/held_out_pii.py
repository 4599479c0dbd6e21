"""Hand-labelled sentences that the generator of the training table did not make: (text, what the field should add as (kind, string))."""

ROWS = [
    ("call me at 555-201-4477 tomorrow", [("local_phone", "555-201-4477")]),
    ("our desk: (212) 555-0188, ask for Ann", [("local_phone", "(212) 555-0188")]),
    ("fax 415.555.2671 is off at night", [("local_phone", "415.555.2671")]),
    ("Ruf mich an: 303 555 0142!", [("local_phone", "303 555 0142")]),
    ("two lines, 617-555-0101 and 617-555-0102", [("local_phone", "617-555-0101"), ("local_phone", "617-555-0102")]),
    ("the number 206-555-0177 was disconnected", [("local_phone", "206-555-0177")]),
    ("dial (909) 555-4410 or write", [("local_phone", "(909) 555-4410")]),
    ("appelez le 514-555-0133.", [("local_phone", "514-555-0133")]),
    ("llame al 787 555 0199 ahora", [("local_phone", "787 555 0199")]),
    ("phone: 800-555-9000", [("local_phone", "800-555-9000")]),
    ("reach the office on (646) 555-7788", [("local_phone", "(646) 555-7788")]),
    ("cell 919.555.0123, home 919.555.0124", [("local_phone", "919.555.0123"), ("local_phone", "919.555.0124")]),
    ('api_key = "9f8e7d6c5b4a39281706f5e4d3c2b1a0"', [("secret", "9f8e7d6c5b4a39281706f5e4d3c2b1a0")]),
    ("export TOKEN=3b1f5c0a9e8d7c6b5a4f3e2d1c0b9a8f7e6d5c4b", [("secret", "3b1f5c0a9e8d7c6b5a4f3e2d1c0b9a8f7e6d5c4b")]),
    ('password: "a81bc81bdeadbeef4e5dabff90865d1e13b1"', [("secret", "a81bc81bdeadbeef4e5dabff90865d1e13b1")]),
    ("secret = 'f00dbabe1234567890abcdef12345678'", [("secret", "f00dbabe1234567890abcdef12345678")]),
    ("key=0123456789abcdef0123456789abcdef please rotate", [("secret", "0123456789abcdef0123456789abcdef")]),
    ('clé = "c0ffee00c0ffee11c0ffee22c0ffee33"', [("secret", "c0ffee00c0ffee11c0ffee22c0ffee33")]),
    ("token 7d8f9a0b1c2d3e4f5a6b7c8d9e0f1a2b was leaked", [("secret", "7d8f9a0b1c2d3e4f5a6b7c8d9e0f1a2b")]),
    ("in 1999 there were 12 of 300 left", []),
    ("the score was 3-2 after 90 minutes", []),
    ("on 2021-03-04 at 10:45 we met", []),
    ("pages 101-115 of volume 12", []),
    ("it cost 1,200.50 or 1.200,50", []),
    ("version 2.10.3 replaces 2.9", []),
    ("chapter 7, verse 14", []),
    ("the room 404 is next to 405", []),
    ("a ratio of 16:9 at 1920x1080", []),
    ("mail a.b@c.example.com for 20% off", []),
    ("see section 4.2.1 and table 3", []),
    ("E=mc2 and x = 3 + 4", []),
    ("he said 'yes' twice in 10 years", []),
    ("the year 2020/2021 budget of 45000", []),
    ("take 2 of 250 mg each 8 hours", []),
    ("nothing private here, only words and words", []),
    ("flight 815 left gate 23 at 4", []),
    ("born 12.04.1980 in Bonn", []),
    ("model b2b4you sold 77 units", []),
    ("order 12 34 56 eggs", []),
]
