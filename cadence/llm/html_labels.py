"""The labelled table of the main-text classifier: pages, block by block.

A page is a frame with places for texts: ``{}`` takes the next of ``LONG``,
``[]`` the next of ``SHORT``, so no two pages share their run of texts.  ``MARKS``
has one figure per block, 1 for main text.
"""

from __future__ import annotations

LONG = (
    "The ferry leaves at six and takes an hour to cross the bay when the wind is from the west.",
    "My grandmother kept bees behind the house and never wore a veil, not even in the swarming weeks of May.",
    "Water boils sooner in the mountains, which is why beans take longer to cook up there than at the coast.",
    "In the end the council voted to keep the old bridge and to build the new one half a mile upstream, where the bank is firm.",
    "Nobody had told the new teacher that the stove in the second classroom smoked whenever it rained.",
    "Salt the cucumbers, leave them for twenty minutes and press the juice out before you add the cream and the dill.",
    "The survey found fewer swallows than in any year since counting began, and the reasons are still being argued about.",
    "She bought the camera for the price of a bicycle and learned to develop film in the cellar, by the light of a red bulb.",
    "A good knife needs less force, so it is the blunt one that slips and cuts you.",
    "They walked for two days along the canal and met only a man with a dog and a boat full of gravel.",
    "The orchestra rehearsed in a gym that winter because the roof of the hall had come down under the snow.",
    "Copper pipes hum when the pressure is too high; a valve for a few coins puts an end to it.",
    "Der Zug hielt auf freier Strecke, und niemand im Abteil wusste zu sagen, wie lange es dauern würde.",
    "Au printemps les hirondelles reviennent sous le toit de la grange, et l'on entend leurs petits dès le matin.",
    "El mercado abre a las siete, pero los mejores tomates se acaban mucho antes de que llegue la gente del centro.",
    "If the dough sticks to your hands it wants patience and not more flour, for it firms up as it rests.",
    "The judge read the letter twice, folded it along its old creases and asked who had kept it all these years.",
    "Ice had formed between the planks, and with every wave the little harbour creaked like a door in the night.",
    "Most of the maps in the archive are copies, made by clerks who had never seen the rivers that they drew.",
    "The first telephone in the village hung in the bakery, so all the news smelled of bread.",
    "Take the second path after the chapel, since the first one ends at a fence and a very bad tempered goat.",
    "He repaired clocks until his eyes gave out and then he listened to them, which, he said, had always been the better way.",
    "A comet was seen that autumn over the hills to the south, and the price of candles doubled within a week.",
    "The paint was still wet when the mayor leaned on the railing, as the photograph in the museum shows.",
    "Between the wars the factory made pianos, and some of them still stand, out of tune, in the schools of the valley.",
    "I have been coming here for thirty years and the soup has never been the same twice, thank you for writing about it.",
    "Great read, my father worked at that mill and told the story about the flood in just the same words.",
    "Sorry but this is wrong, the road was closed in spring and not in summer, I was there with my whole family.",
    "Does anybody know whether the seeds can be kept over the winter, or do I have to sow them at once?",
    "We and our partners store data on your device to measure how our pages are used and to show what may interest you.",
    "By using this site you agree to our terms, and to everything in them that you have not read to the end.",
    "All rights reserved; no part of this site may be copied without a letter from the people who run it.",
    "Sign up for our weekly letter and get the best stories on Friday, before everybody else has seen them.",
    "Order two pairs of boots this week and we will send a tin of wax along for nothing at all.",
    "The information on this page is given without any warranty and does not replace the advice of a doctor or a lawyer.",
    "This project is paid for by the members of a society that was founded in the last century to keep the woods open to walkers.",
    "About the author: she lives with two cats in an old station house and writes about trains, weather and soup.",
    "Please log in to write a reply, or create an account with your mail address and a password of eight signs at least.",
)
SHORT = (
    "It rained.", "Not so fast.", "Home at last", "Three days later", "Why?", "Soil and water", "Old songs", "The end.", "A cold May",
    "Nobody knew.", "Tools", "So be it.", "Part two", "On the way", "Bread, salt, wine", "Yes and no",
)

_ART = "<article><h1>[]</h1><p>{}</p><p>{}</p><p>[]</p><p>{}</p></article>"
_LONG_ART = "<article><h1>[]</h1>" + "<p>{} {} {}</p><p>{}</p>" * 5 + "</article>"
_COMMENTS = "<section id=comments><h2>[]</h2>" + "<div class=comment><p>{}</p></div>" * 9 + "</section>"
_MENU = "<nav><ul><li><a href=/a>[]</a></li><li><a href=/b>[]</a></li></ul></nav>"
_PLAIN = "<p>{}</p><p>{}</p><p>{} <a href=/l>[]</a></p>"

PAGES = (
    # an article, and boilerplate of every size beside it
    (f"<body>{_MENU}{_ART}<footer><p>{{}}</p></footer></body>", "00" "11111" "0"),
    (f"<body>{_ART}{_COMMENTS}</body>", "11111" + "0" * 10),
    (f"<body>{_ART}<div id=respond><p>{{}}</p></div><ol class=comment-list><li>{{}}</li><li>[]</li><li>{{}}</li></ol></body>", "11111" "0000"),
    (f"<body><div class=cookie-notice><p>{{}}</p><p>{{}} {{}} {{}}</p><p>{{}} {{}} {{}}</p></div>{_ART}</body>", "000" "11111"),
    (f"<body>{_ART}<footer class=disclaimer><p>{{}} {{}} {{}}</p><p>{{}} {{}}</p><p>{{}}</p></footer></body>", "11111" "000"),
    (f"<body><header><div>[]</div><p>{{}}</p></header><main><h1>[]</h1><p>{{}}</p><ul><li>{{}}</li><li>[]</li></ul></main><aside><h3>[]</h3><p>{{}}</p></aside></body>", "00" "1111" "00"),
    (f"<body><article><header><h1>[]</h1></header><p>{{}}</p><aside class=related><a href=/r>[]</a></aside><p>[]</p><blockquote>{{}}</blockquote></article><form><label>[]</label><p>{{}}</p></form></body>", "110" "11" "00"),
    (f"<body><article><p>{{}}</p><div class=ad-slot>{{}}</div><p>{{}}</p><div class=share><a href=/f>[]</a></div><p>[]</p></article><section class=replies><p>{{}}</p><p>{{}}</p></section></body>", "10101" "00"),
    (f"<body><article><p>[]</p><p>[]</p><p><a href=/w>[]</a></p><div>[]</div></article><footer><p>{{}}</p><p>{{}}</p></footer></body>", "1111" "00"),
    (f"<body>{_MENU}<article><p>[]</p></article><div id=disqus><p>{{}} {{}}</p><p>{{}}</p></div></body>", "00" "1" "00"),
    (f"<body><article><p>{{}}</p><section class=comments><p>{{}}</p><p>{{}}</p><p>{{}}</p></section></article></body>", "1" "000"),
    (f"<body><article><table><tr><td>[]</td><td>[]</td></tr></table><ul><li>{{}}</li><li>[]</li></ul><p>{{}}</p></article><div class=newsletter><p>{{}}</p></div></body>", "11" "11" "1" "0"),
    (f"<body>{_ART}<div class=related><article><p>{{}}</p></article><article><a href=/m>[]</a></article></div><section id=comments><article class=comment><p>{{}}</p></article></section></body>", "11111" "00" "0"),
    # unmarked boxes beside an article
    (f"<body><div>[]</div><div>{{}}</div>{_ART}<div><a href=/n>[]</a></div><div>{{}}</div></body>", "00" "11111" "00"),
    (f"<body><table><tr><td><a href=/1>[]</a></td><td><a href=/2>[]</a></td></tr></table>{_ART}<p>{{}}</p><p>[]</p></body>", "00" "11111" "00"),
    (f"<body><div>{{}} {{}}</div><div>{{}} {{}} {{}}</div>{_ART}<div>{{}} {{}}</div><div>{{}} {{}} {{}}</div></body>", "00" "11111" "00"),
    (f"<body><p>{{}} {{}}</p><article>{_PLAIN}<p>[]</p></article><p>{{}} {{}} {{}}</p><p>{{}} {{}}</p></body>", "0" "1111" "00"),
    (f"<body>{_MENU}<main>{_PLAIN}</main><div>{{}} {{}}</div><div>{{}} {{}}</div><div>{{}}</div></body>", "00" "111" "000"),
    (f"<body><div>{{}}</div>{_LONG_ART}<div>{{}}</div></body>", "0" + "1" * 11 + "0"),
    (f"<body><div><p>{{}} {{}}</p></div>{_LONG_ART}<p>{{}}</p></body>", "0" + "1" * 11 + "0"),
    (f"<body><h2>[]</h2><div>{{}}</div>{_LONG_ART}<div>[]</div><div>{{}}</div></body>", "00" + "1" * 11 + "00"),
    (f"<body><p>{{}}</p>{_LONG_ART}</body>", "0" + "1" * 11),
    (f"<body>{_LONG_ART}<p>{{}} {{}}</p><div>[]</div></body>", "1" * 11 + "00"),
    # a short article among longer boxes
    ("<body><div>{} {}</div><article><p>[]</p></article><p>{} {}</p><div>{}</div></body>", "0" "1" "00"),
    ("<body><div>{} {} {}</div><div>{} {}</div><article><p>[]</p></article><p>{} {} {}</p><div>{} {}</div></body>", "00" "1" "00"),
    ("<body><header>{} {}</header><p>{}</p><main><p>[]</p><p>[]</p></main><div>{} {}</div><p>{} {} {} {}</p></body>", "00" "11" "00"),
    # an article that ends the page, or is all of it
    (f"<body>{_MENU}{_ART}</body>", "00" "11111"),
    (f"{_ART}", "11111"),
    ("<body><article><p>[]</p></article></body>", "1"),
    ("<body><article><p>{}</p></article></body>", "1"),
    ("<article><p>{} {}</p><p>{}</p><p>[]</p></article>", "111"),
    (f"<body>{_MENU}<main>{_PLAIN}<ul><li>[]</li><li>[]</li></ul></main></body>", "00" "11111"),
    ("<body><nav><a href=/>[]</a></nav><article><p>{} {} {}</p><p><a href=/x>[]</a></p><p>{}</p><p><a href=/y>[]</a></p></article></body>", "0" "1111"),
    ("<body><article><h1>[]</h1><p><a href=/x>{}</a></p></article></body>", "11"),
    ("<body><div><a href=/>[]</a></div><p>{} {}</p><p>{}</p><p>{} {}</p></body>", "0" "111"),
    ("<p>{}</p><p>{} {}</p><p>{}</p>", "111"),
    ("<body>{} {}</body>", "1"),
    # containers that are named like boilerplate
    (f"<body>{_MENU}<div class=content-with-sidebar>{_ART}<div class=sidebar><p>{{}}</p></div></div></body>", "00" "11111" "0"),
    (f"<body><div class=widget-area><div class=social-layout>{_ART}</div></div><div class=post-share><a href=/f>[]</a></div><div class=entry-meta>{{}}</div></body>", "11111" "00"),
    (f"<body><div class='main has-ads'>{_PLAIN}<p>{{}}</p><p>[]</p><div class=ads>{{}}</div></div><aside><p>{{}}</p></aside></body>", "11111" "0" "0"),
    (f"<body><div class='content no-sidebar'>{_PLAIN}<p>[]</p><p>{{}}</p></div><div class=banner>{{}}</div></body>", "11111" "0"),
    (f"<body><div class=elementor-widget>{_PLAIN}<p>{{}}</p></div><div class=elementor-widget><p>[]</p></div><div class=widget><a href=/a>[]</a></div></body>", "1111" "0" "0"),
    (f"<body><div class=widget>{_PLAIN}</div></body>", "111"),
    (f"<body><div class=page-social>{_PLAIN}<p>{{}}</p></div><div class=promo>{{}}</div></body>", "1111" "0"),
    ("<body>" + "<div class=elementor-widget><article><p>{} {}</p><p>{}</p></article></div>" * 5 + "<div class=related><article><p>{}</p></article></div></body>", "1" * 10 + "0"),
    (f"<body><article><div class=text-widget><p>{{}}</p><p>{{}}</p><p>[]</p><p>{{}}</p></div><div class=social><p>[]</p></div></article></body>", "1111" "0"),
    # a form around the whole page
    (f"<body><form>{_MENU}<div>{_PLAIN}<p>{{}}</p></div><div><a href=/n>[]</a></div></form></body>", "00" "1111" "0"),
    (f"<body><form>{_MENU}{_ART}<footer>{{}}</footer></form></body>", "00" "11111" "0"),
    # no article at all: long paragraphs without links
    ("<body><div><a href=/>[]</a> <a href=/2>[]</a></div><div>" + _PLAIN + "<p>{}</p></div><div><a href=/n>[]</a></div><div>[]</div></body>", "0" "1111" "00"),
    ("<body><div><a href=/>[]</a></div><div>[]</div><div>{}</div><div>{} {}</div><div><a href=/t>[]</a></div><div>[]</div></body>", "00" "11" "00"),
    ("<body><div><a href=/>[]</a></div><div>[]</div><div>{} {}</div><div>{}</div><div>{} {}</div><div><a href=/t>{}</a></div></body>", "00" "111" "0"),
    ("<body><div><a href=/1>{}</a> <a href=/2>[]</a></div><p>{} {}</p><p>[]</p><p>{}</p><div><a href=/3>{}</a></div><div><a href=/4>{} {}</a></div></body>", "0" "111" "00"),
    ("<body><ul><li><a href=/1>{}</a></li><li><a href=/2>{}</a></li></ul><div>{}</div><div>[]</div><div>{} {}</div><p>[]</p><div>{}</div><div>[]</div></body>", "00" "11111" "0"),
    ("<body><div><a href=/1>[]</a></div><p>{}</p><p>[]</p><p>{} {}</p><p>[]</p><p>{}</p><ul><li><a href=/2>{}</a></li><li><a href=/3>{}</a></li><li>[]</li></ul></body>", "0" "11111" "000"),
    ("<body><div>[]</div><div><a href=/1>{}</a></div><p>{} {}</p><p>[]</p><p>{}</p><p>[]</p><p>{} {}</p><div>[]</div><div><a href=/2>{}</a></div></body>", "00" "11111" "00"),
    ("<body><div class=cookies><p>{} {}</p><p>{} {}</p><p>{}</p></div><div><p>{}</p><p>{}</p></div><footer>{} {}</footer></body>", "000" "11" "0"),
    (f"<body><div class=post><h2>[]</h2><p>[]</p>{_PLAIN}</div><div class=sidebar><p>{{}}</p><p><a href=/a>[]</a></p></div><div class=banner>{{}}</div></body>", "11111" "00" "0"),
    (f"<body>{_MENU}<div>{_PLAIN}</div>{_COMMENTS}</body>", "00" "111" + "0" * 10),
)


def labelled_pages() -> list[tuple[str, str]]:
    """(html, marks) with the texts filled in."""
    out, long_at, short_at = [], 0, 0
    for frame, marks in PAGES:
        pieces = frame.replace("[]", "\0{}").split("{}")
        page = pieces[0]
        for piece in pieces[1:]:
            if page.endswith("\0"):
                page = page[:-1] + SHORT[short_at % len(SHORT)]
                short_at += 1
            else:
                page += LONG[long_at % len(LONG)]
                long_at += 7 if long_at % 5 == 0 else 1
            page += piece
        out.append((page, marks))
    return out
