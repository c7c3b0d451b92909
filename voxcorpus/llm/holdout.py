"""Hand-checked texts: written for this library and labelled by reading (1: not running prose)."""

from __future__ import annotations

#: Prose to train on where a corpus has none.
SEED_PROSE = [
    "The ferry was late again, so we sat on the wall and shared an orange. Nobody minded much. When the bell rang we "
    "picked up our bags and walked down to the water, where the captain was already waving at us.",
    "I have kept this diary since the winter my brother moved away. It began as a list of things to tell him, and then "
    "it became a habit. Some days there is only the weather, but that is enough for me.",
    "Wir sind am frühen Morgen losgefahren, weil die Straße sonst voll ist. Unterwegs hat es geregnet, und das Kind "
    "hat die ganze Zeit geschlafen. Am Ende waren wir eine Stunde zu früh da.",
    "La boulangerie ouvre à six heures, mais il y a toujours quelqu'un devant la porte. On parle du temps et des "
    "voisins. Puis chacun repart avec son pain sous le bras, et la rue se tait.",
    "El tren salió con retraso y nadie supo decirnos por qué. Mi hermana leía un libro que ya había leído. Yo miraba "
    "los campos, que en esa época del año son de un verde muy claro.",
    "Мы долго искали дорогу к озеру, потому что карта была старая. Потом встретили рыбака, и он показал нам тропу. "
    "Вода была холодная, но никто не хотел уходить.",
    "奶奶的院子里有一棵老树。每年秋天我们都去摘果子，然后坐在门口慢慢地吃。后来那棵树被风吹倒了，大家都很难过。",
    "村の小さな駅には、もう電車が来ない。それでも朝になると、老人が一人でベンチに座る。誰を待っているのかは、だれも知らない。",
    "บ้านของยายอยู่ใกล้แม่น้ำ ทุกเช้าเราเดินไปตลาดด้วยกัน แล้วกลับมาทำกับข้าวก่อนที่แดดจะร้อน ฉันยังจำกลิ่นของครัวได้",
    "Το καράβι έφυγε πριν από την ώρα του και μείναμε στο λιμάνι. Δεν μας πείραξε, γιατί η μέρα ήταν ωραία και είχαμε ψωμί "
    "και ελιές. Το βράδυ μας πήρε ένας ψαράς με τη βάρκα του.",
    "गाँव का स्कूल नदी के उस पार है और बच्चे हर रोज़ नाव से जाते हैं। जब पानी बढ़ता है तो छुट्टी हो जाती है। "
    "तब वे घर में बैठकर कहानियाँ सुनते हैं।",
    "كان جدي يزرع الليمون في حديقة صغيرة خلف البيت. في كل صباح كان يسقي الأشجار ثم يجلس على الكرسي ويقرأ. "
    "لا أحد يعرف من أين جاء بتلك البذور.",
    "Quando a chuva parou, fomos ver o jardim. As flores estavam no chão e a mesa tinha caído, mas o limoeiro não perdeu "
    "uma folha. A minha avó riu e disse que ele é teimoso como ela.",
    "so then we took the bus because the car would not start and it was already late and my cousin had to be at work by "
    "eight. he was not happy about it. i told him that it was not my fault.",
]

HOLDOUT: list[tuple[str, int]] = [
    ("My aunt grows tomatoes on the roof. She says the wind is good for them, and that the pigeons are not.", 0),
    ("we left before the sun was up and the road was empty then the fog came in and we had to stop for an hour", 0),
    ("THE MEETING HAS BEEN MOVED TO THURSDAY. PLEASE BRING THE OLD KEYS, BECAUSE THE LOCKS WILL BE CHANGED THAT DAY.", 0),
    ("the rain is on the window\nand the kettle is on the stove\nyou said that you would write to me\nbut the post has not come", 0),
    ("Ana: Are you coming to the game tonight?\nBo: I don't think so, it is too cold for me.\nAna: Then we will watch it at home.", 0),
    ("In 2019 the club had 412 members, in 2021 only 388, and by May 2023 the figure was 401, which is 3.4% more than the year before.", 0),
    ("You will need three things for this walk.\n\n- a map\n- a coat\n- two apples\n\nThe path is easy at first, but it climbs when you get to the bridge, so take your time.", 0),
    ("Das Brot war hart, und der Käse war alt. Trotzdem haben wir alles gegessen, weil wir den ganzen Tag im Wald waren.", 0),
    ("Le chat est sur le toit et il ne veut pas descendre. On a mis du lait dans la cour, mais cela ne sert à rien.", 0),
    ("A loja fecha às seis e não abre no domingo. Se você quiser o pão do dia, é preciso chegar cedo.", 0),
    ("Сегодня мы не пошли в парк, потому что на улице был сильный ветер. Дети играли дома и смотрели на снег.", 0),
    ("昨天下了一整天的雨，我们没有出门。妹妹在看书，我在做饭。晚上雨停了，月亮出来了。", 0),
    ("駅の前に古い本屋がある。店の人はいつも同じ椅子に座っている。今日は雨なので、誰も来ない。", 0),
    ("ร้านกาแฟเปิดตั้งแต่เช้า คนในซอยชอบมานั่งคุยกันที่นี่ วันนี้ฝนตกและไม่มีใครมา", 0),
    ("Η βροχή σταμάτησε το μεσημέρι και τα παιδιά βγήκαν στην αυλή. Η γιαγιά τα κοιτούσε από το παράθυρο.", 0),
    ("बारिश दो दिन से हो रही है और नदी का पानी बढ़ गया है। हम लोग घर में बैठे हैं।", 0),
    ("المطر لم يتوقف منذ الصباح، ولا أحد في الشارع. جلسنا قرب النافذة وشربنا الشاي.", 0),
    ("the dog that lives next door is afraid of cats, it runs under the car when it sees one, and then it will not come out until we call", 0),
    ("Dear all, the lift is out of order. It will be mended on Monday, or so we are told. Until then please use the stairs at the back of the house.", 0),
    ("She had a plan for the\ngarden, and it was a good\none. There would be beans\nby the wall and a bench in\nthe shade of the old pear.", 0),
    ("milk\nbread\nsix eggs\nbutter\nsoap\napples\nrice\ncoffee\nonions", 1),
    ("- red lamp\n- desk chair\n- bookshelf\n- grey rug\n- coat hooks\n- mirror\n- small table", 1),
    ("1. Oslo\n2. Bergen\n3. Narvik\n4. Bodo\n5. Tromso\n6. Alta\n7. Molde", 1),
    ("name,qty,price\nbolt,40,0.12\nnut,40,0.08\nwasher,80,0.02\nscrew,120,0.05\nhinge,6,1.90", 1),
    ("| team | won | lost |\n| north | 12 | 3 |\n| south | 9 | 6 |\n| east | 4 | 11 |\n| west | 8 | 7 |", 1),
    ("alpha      12   0.44\nbeta        7   0.31\ngamma      19   0.02\ndelta       3   0.90\nepsilon    22   0.15", 1),
    ("2023-01-04 08:00:01 INFO start pid=311\n2023-01-04 08:00:02 WARN slow disk=sda\n2023-01-04 08:00:09 INFO ready port=80", 1),
    ("/img/logo.png\n/css/site.css\n/js/app.js\n/blog/first-post.html\n/blog/second-post.html\n/about.html", 1),
    ("QmFzZTY0IGlzIG5vdCBwcm9zZSBidXQgYSBkdW1w\nYW5kIGl0IGdvZXMgb24gYW5kIG9uIGFuZCBvbg\nZm9yZXZlcitub3RoaW5n", 1),
    ("==========\n----------\n**********\n..........\n##########", 1),
    ("a r b o l k e n d i t u m a r e l s o n p i t a k o", 1),
    ("cheap shoes, running shoes, leather boots, sandals, kids shoes, shoe sale, sneakers, trail shoes, hiking boots", 1),
    ("garden lamp silver run quick paper mountain drop yellow sing chair bottle strong wander glass metal jump apple window", 1),
    ("Window silver marble quick running table garden Lamp river engine carbon yellow finger bottle strong melody pepper.", 1),
    ("item\tcount\tshare\npen\t44\t0.21\nruler\t12\t0.06\nink\t90\t0.43\npad\t63\t0.30", 1),
    ("id;status;owner\n100;open;kim\n101;done;lee\n102;open;ada\n103;done;bo\n104;late;kim", 1),
    ("{\"a\": 1, \"b\": [2, 3]}\n{\"a\": 4, \"b\": [5, 6]}\n{\"a\": 7, \"b\": [8, 9]}", 1),
    ("xk3 99 zz0 q1q1 7f7f aa09 bb12 cc98 dd00 ee71 ff23 0a0a 1b1b 2c2c", 1),
    ("Home\nShop\nContact\nCart\nLogin\nHelp\nImprint", 1),
    ("* Montag\n* Dienstag\n* Mittwoch\n* Donnerstag\n* Freitag\n* Samstag", 1),
]
