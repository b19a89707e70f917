"""Pages written by hand, none from the generator of training pages: (html, main text)."""

A = "The river rose during the night, and by morning the lower bridge was under water."
B = "Nobody was hurt, the mayor said, but forty families had to leave their homes."
C = "Engineers expect the level to fall again on Thursday, when the rain should stop."
S = "El ayuntamiento abrirá la nueva biblioteca en septiembre, después de dos años de obras."
T = "El edificio tiene tres plantas, una sala de lectura y un patio con árboles viejos."
G = "Der Wald ist seit Jahren zu trocken, deshalb pflanzen die Förster nun andere Bäume."
H = "Eichen und Linden kommen mit der Hitze besser zurecht, sagt die Leiterin des Amtes."
ABC, ST, GH = f"{A}\n{B}\n{C}", f"{S}\n{T}", f"{G}\n{H}"
P, PS, PG = f"<p>{A}</p><p>{B}</p><p>{C}</p>", f"<p>{S}</p><p>{T}</p>", f"<p>{G}</p><p>{H}</p>"
NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li></ul></nav>"
FOOT = "<footer>&copy; 2024 River Press. All rights reserved.</footer>"

PAGES = [
    (f"<html><body>{NAV}<article><h1>Flood</h1>{P}</article>{FOOT}</body></html>", f"Flood\n{ABC}"),
    (f"<body><main><h1>Flood</h1>{P}</main>{FOOT}", f"Flood\n{ABC}"),
    (f'<body><div class="header-content main-article">{P}</div>{FOOT}', ABC),
    (f"<body><h1>Flood</h1>{P}</body>", f"Flood\n{ABC}"),
    (f"<html>{P}</html>", ABC),
    (f"<body>{NAV}<h1>Flood</h1>{P}{FOOT}</body>", f"Flood\n{ABC}"),
    (f'<body><div id="cabecera"><a href=/>Inicio</a> <a href=/c>Cultura</a></div><div id="contenido">{PS}</div><div id="pie">&copy; Diario</div>', ST),
    (f'<body><div class="navi"><a href=/>Start</a> <a href=/p>Politik</a></div><div class="artikel">{PG}</div><div class="impressum">Impressum, Verlag</div>', GH),
    (f'<body><div class="x1"><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li><li><a href=/b>Jobs</a></li></ul></div><div class="x9">{P}</div>', ABC),
    (f'<body><ul class="menu"><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul><div class="post-body">{P}</div>', ABC),
    (f'<body><article>{P}</article><section id="comments"><h2>Comments</h2><p>Great piece, thank you for it.</p><p>I live there and it was bad.</p></section>', ABC),
    (f'<body><article><p>{A}</p><div class="ad">Buy new boots today, half price only this week.</div><p>{B}</p></article>', f"{A}\n{B}"),
    (f'<body><div class="cookie-banner">We use cookies to make this site better. <button>Accept</button></div><article>{P}</article>', ABC),
    (f'<body><aside><h3>Related</h3><ul><li><a href=/1>Older floods</a></li><li><a href=/2>New dam</a></li></ul></aside><article>{P}</article>', ABC),
    (f'<body><article>{P}<div class="share-buttons"><a href=/t>Post</a> <a href=/f>Share</a></div></article>', ABC),
    (f'<body><article>{P}<form action=/s><label>Mail</label><input name=m><button>Subscribe</button></form></article>', ABC),
    (f"<body><article><h1>Flood</h1><p>{A}<h2>Homes</h2><p>{B}</article>{FOOT}", f"Flood\n{A}\nHomes\n{B}"),
    (f"<body><article><p>{A}</p><ul><li>{B}</li><li>{C}</li></ul></article>", ABC),
    (f"<body><article><p>{A}</p><blockquote>{B}</blockquote><p>{C}</p></article>", ABC),
    (f"<body><article><div>{A}</div><div>{B}</div><div>{C}</div></article>", ABC),
    (f'<body><div id="page"><div class="wrapper"><div class="entry-content">{P}</div></div></div>', ABC),
    (f"<body><article><p>{A}</p><script>var a = '<p>no</p>';</script><style>p {{}}</style><p>{B}</p></article>", f"{A}\n{B}"),
    (f"<body><article><p>The caf&eacute; &amp; bar &lt;Rio&gt; was closed, as its cellar stood full of water.</p><p>{B}</p></article>", f"The café & bar <Rio> was closed, as its cellar stood full of water.\n{B}"),
    (f"<body>{NAV}{NAV}<main><article><h1>Bibliothek</h1>{PG}</article></main>{FOOT}", f"Bibliothek\n{GH}"),
    (f'<body><header><h1>River Press</h1><a href=/>Home</a></header><article><h2>Flood</h2>{P}</article>', f"Flood\n{ABC}"),
    (f'<body><article><header><h1>Flood</h1></header>{P}</article>{FOOT}', f"Flood\n{ABC}"),
    (f'<body><section class="story">{PS}</section><section class="newsletter"><p>Get our letter each week.</p><input name=m></section>', ST),
    (f'<body><div class="sidebar"><h4>Popular</h4><a href=/1>Dam</a> <a href=/2>Rain</a> <a href=/3>Wind</a></div><div class="text">{P}</div>', ABC),
    (f'<body><nav class="breadcrumbs"><a href=/>Home</a> / <a href=/n>News</a></nav><article><p>See <a href=/m>the map</a>. {A}</p><p>{B}</p></article>', f"See the map. {A}\n{B}"),
    (f"<body><article><table><tr><td>Monday</td><td>Level two</td></tr></table>{P}</article>", f"Monday\nLevel two\n{ABC}"),
    (f"<body><article>   <p>\n {A}\n\n</p><p>{B}<br>{C}</p></article>", f"{A}\n{B} {C}"),
    (f'<body><article>{P}</article><div class="publicidad">Compre botas nuevas hoy mismo, a mitad de precio.</div>', ABC),
    (f'<body><div role="main">{P}</div><div role="contentinfo">River Press, 4 Mill Street</div>', ABC),
    ("<body></body>", ""),
]
