"""Texts written for the tests alone, after the operators: nothing was chosen or trained by them.

INBOX: (text, 1 if it is no running prose). DRAFTS: (path, text, pieces).
"""

INBOX = [
    ("We moved the launch to Thursday because the printer needed two more days. Nobody minded, and the extra time let us fix the captions on page four.", 0),
    ("THE OFFICE WILL BE CLOSED ON MONDAY. PLEASE LEAVE YOUR KEYS AT THE FRONT DESK AND TELL YOUR TEAM BEFORE YOU GO.", 0),
    ("i wrote to the landlord again\nhe says the roof will be done in may\nuntil then we keep the buckets where they are\nand hope for a dry april", 0),
    ("Anna: Did you read the second draft?\nPiet: I did, and I think the ending is still too long.\nAnna: Then cut it, but keep the line about the bridge.", 0),
    ("Im Frühjahr haben wir die alte Werkstatt ausgeräumt. Dabei fanden wir Briefe, die seit 1954 niemand mehr gelesen hatte, und einen Hut.", 0),
    ("La réunion a duré trois heures et personne n'a pris de décision. Nous nous retrouvons mardi avec des chiffres plus clairs.", 0),
    ("El tren llegó tarde otra vez, así que caminamos hasta el mercado y compramos pan, queso y dos botellas de agua para el viaje.", 0),
    ("Мы долго спорили о названии, но в конце концов оставили старое. Оно короче, и его уже знают все наши читатели.", 0),
    ("今天下午我们讨论了新的标题。大家都觉得第一段太长了，所以明天再改一次，然后发给编辑。", 0),
    ("Revenue rose 4.2 % to 118 million in 2023, while costs fell by 7 million; of the 64 shops opened since 2019, 58 now make money, and we expect 12 more by June.", 0),
    ("Before you travel, read this once more. You will need three things:\n\n- a ticket\n- a coat\n- patience\n\nThe rest can be bought on the way, and most of it is cheaper there.", 0),
    ("well so the thing is we never really asked them what they wanted we just assumed it was the same as last year and it was not", 0),
    ("- bread\n- milk\n- two lemons\n- washing powder\n- stamps\n- light bulbs", 1),
    ("name;city;year\nAnders;Oslo;1981\nBrandt;Kiel;1975\nCosta;Porto;1990\nDuval;Lille;1988", 1),
    ("| item | qty | price |\n|---|---|---|\n| bolt | 40 | 0.12 |\n| nut | 40 | 0.08 |\n| washer | 80 | 0.02 |", 1),
    ("2023-11-02 08:14:55 ERROR worker=7 timeout after 30s\n2023-11-02 08:14:58 INFO worker=7 restart\n2023-11-02 08:15:01 INFO worker=7 ready", 1),
    ("summer shoes, cheap shoes, running shoes, red shoes, shoes online, shoes sale, kids shoes, leather shoes, best shoes", 1),
    ("kdjfh sdkfjh weoriu xcvmnb sdlkfj woeiru cvbnm qpwoe sdkfj zxmcn wueyr sdjhf", 1),
    ("aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQgZW5jb2RlZCB0ZXh0IHdpdGhvdXQ\nYW55IHByb3NlIGluIGl0IGF0IGFsbCBqdXN0IGJ5dGVzIGFuZCBtb3JlIGJ5dGVz", 1),
    ("table window orange seven under carpet jump although bottle green Tuesday piano quickly river stone eleven above paper", 1),
    ("/var/log/app.log\n/var/log/db.log\n/etc/hosts\n/usr/local/bin/run\n/home/ada/notes.txt\n/tmp/x1", 1),
    ("1. Introduction\n2. Methods\n3. Results\n4. Discussion\n5. References\n6. Appendix A\n7. Appendix B", 1),
    ("======== ======== ========\n####  ####  ####  ####\n-------- -------- --------\n~~~~ ~~~~ ~~~~ ~~~~", 1),
    ("Brot\nMilch\nZwei Zitronen\nWaschpulver\nBriefmarken\nGlühbirnen\nÄpfel\nKäse", 1),
]

DRAFTS = [
    ("a.md", "Release notes\n=============\n\nWe fixed the *import* and the `export` button.\n\n1. Faster start\n2. Smaller files\n   - about 40 % less\n\n```sh\nmake clean\nmake all\n```\n",
     {("heading", "Release notes"), ("list_item", "Faster start"), ("list_item", "Smaller files"), ("list_item", "about 40 % less"), ("code", "make clean make all")}),
    ("b.html", "<article><h1>Tea &mdash; a guide</h1><p>Warm the pot first. It takes <i>one</i> minute.</p><ol><li>Boil</li><li>Pour <b>slowly</b></li></ol></article>",
     {("heading", "Tea — a guide"), ("list_item", "Boil"), ("list_item", "Pour slowly")}),
    ("c.tex", "\\section{Energy}\nThe total is $E = m c^2$ for all masses.\n\\begin{align}\na &= b + c\n\\end{align}\n\\begin{itemize}\n\\item light\n\\item \\textbf{heavy} ones\n\\end{itemize}",
     {("heading", "Energy"), ("formula", "E = m c^2"), ("formula", "a &= b + c"), ("list_item", "light"), ("list_item", "heavy ones")}),
    ("d.txt", "== History ==\nThe [[harbour]] was built in 1820.<ref>Old book</ref>\n\n* first pier\n* second pier\n** its lamp\n\n== See also ==\n{{stub}}",
     {("heading", "History"), ("heading", "See also"), ("list_item", "first pier"), ("list_item", "second pier"), ("list_item", "its lamp")}),
    ("e.md", "Dear all, the price went from $12 to $15 and nobody asked why. Use * where you must.\n\nIs #4 still open? I think so, but R&D should say.", set()),
    ("f.md", "### Setup ###\n\n> Quoted words, no more.\n\n* take the key\n* turn it\n\nThe sum $\\sum_i x_i$ is finite.\n\n~~~\nx = {1: 'a'}\n~~~",
     {("heading", "Setup"), ("list_item", "take the key"), ("list_item", "turn it"), ("formula", "\\sum_i x_i"), ("code", "x = {1: 'a'}")}),
    ("g.wiki", "'''Quay''' is a [https://q.example place].\n\n# arrive\n# unload\n\n<syntaxhighlight lang=\"python\">\nprint(1)\n</syntaxhighlight>\nIts size is <math>r^2 \\pi</math>.",
     {("list_item", "arrive"), ("list_item", "unload"), ("code", "print(1)"), ("formula", "r^2 \\pi")}),
    ("h.html", "<div><h2>Parts</h2><ul><li>One<ul><li>One and a half</li></ul></li><li>Two</li></ul><pre>if a &lt; b:\n    stop()</pre><script>var h2 = '<h2>no</h2>';</script></div>",
     {("heading", "Parts"), ("list_item", "One"), ("list_item", "One and a half"), ("list_item", "Two"), ("code", "if a < b: stop()")}),
    ("i.tex", "\\subsection*{Notes on \\emph{rates}}\nRates fell by 8\\% in May. % not in June\n\\begin{verbatim}\nrate = 0.08 % kept\n\\end{verbatim}",
     {("heading", "Notes on rates"), ("code", "rate = 0.08 % kept")}),
    ("j.txt", "A plain note. It has two lines,\nand nothing else -- no lists, no links.\n\nOnly an aside (see p. 4) and a figure: 3 * 4 = 12.", set()),
]
