"""Language posteriors: by script first, then by a character n-gram naive Bayes model among the languages of that script.

The model is trained at first use on the sentences below, which were written for it and speak of everyday things, so that
it knows nothing of the texts it will judge. A script without a model (Greek, Thai, ...) names its own language, and text
that fits no model is `unknown`.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np

#: Training sentences of the languages that share a script with others.
SAMPLES = {
    "en": "My grandmother kept a small garden behind the house, and every spring she planted beans, carrots and a long row of onions. When we were children we would help her carry water from the well, although most of it ended up on our shoes. The train leaves at half past seven, so you should be at the station before that. I have never seen such a large crowd at the market; people had come from all the villages around the lake. She said that there was nothing to worry about, since the doctor had already looked at his arm. If it rains tomorrow, the children will stay at home and read. Which of these two roads goes to the harbour? He could not remember where he had put his glasses, because he was always thinking of something else. The teacher asked each of them to write down what they had learned during the year. There are many reasons why bread tastes better when it has been baked slowly, but the most important one is time. They were tired after the long walk, yet nobody wanted to go to bed. Both of my brothers work in the north, where winters are dark and the snow lies for months. It is not enough to know the rules of the game; one must also know when they do not apply. Would you mind closing the window? The shop on the corner sells newspapers, stamps, candles and very good cheese. As far as we know, the bridge was built about three hundred years ago by workers who received little more than soup and a place to sleep. This picture shows the town as it used to be, with its low roofs, its narrow streets and the church tower that can be seen from everywhere. An old friend of mine once told me that the best answers are usually short. All human beings are born free and equal in dignity and rights, and should act towards one another in a spirit of brotherhood. Without music the evening would have been rather dull, however we enjoyed the meal. Perhaps we may find another way, since the first one has failed. Only a few visitors noticed that the clock on the wall had stopped. According to the letter, which arrived on Monday, the meeting has been moved to another day, and anyone who wishes to speak must give notice. What happened afterwards is described in the last chapter. The engine runs, the wheels turn, and yet the car does not move, so something inside must be broken. Engineers measure the pressure, change the valve, test the system again and report the results to the office. Please use the side entrance while the front door is being repaired. Neither of us understood the question, hence the silence.",
    "de": "Meine Großmutter hatte hinter dem Haus einen kleinen Garten, und jedes Frühjahr pflanzte sie Bohnen, Möhren und eine lange Reihe Zwiebeln. Als wir Kinder waren, halfen wir ihr beim Wassertragen, obwohl das meiste davon in unseren Schuhen landete. Der Zug fährt um halb acht ab, deshalb solltest du vorher am Bahnhof sein. So viele Menschen habe ich auf dem Markt noch nie gesehen; sie kamen aus allen Dörfern rund um den See. Sie sagte, man müsse sich keine Sorgen machen, weil der Arzt den Arm schon untersucht hatte. Wenn es morgen regnet, bleiben die Kinder daheim und lesen. Welche dieser beiden Straßen führt zum Hafen? Er wusste nicht mehr, wohin er seine Brille gelegt hatte, denn er dachte immer an etwas anderes. Die Lehrerin bat jeden, aufzuschreiben, was im Laufe des Jahres gelernt wurde. Es gibt viele Gründe, warum Brot besser schmeckt, wenn es langsam gebacken wird, aber der wichtigste ist die Zeit. Nach dem langen Weg waren sie müde, doch niemand wollte schlafen gehen. Beide Brüder arbeiten im Norden, wo die Winter dunkel sind und der Schnee monatelang liegt. Es genügt nicht, die Regeln des Spiels zu kennen, man muss auch wissen, wann sie nicht gelten. Könnten Sie bitte das Fenster schließen? Soweit bekannt, wurde die Brücke vor etwa dreihundert Jahren von Arbeitern gebaut, die kaum mehr als Suppe und einen Schlafplatz erhielten. Dieses Bild zeigt die Stadt, wie sie früher war. Alle Menschen sind frei und gleich an Würde und Rechten geboren und sollen einander im Geist der Brüderlichkeit begegnen. Nur wenige Besucher bemerkten, dass die Uhr stehen geblieben war. Laut dem Brief, der am Montag eintraf, ist die Sitzung verschoben worden. Ohne Musik wäre der Abend eher langweilig gewesen, jedoch hat uns das Essen gefallen. Bitte benutzen Sie den Seiteneingang, solange die Tür repariert wird. Vermutlich finden wir einen anderen Weg, da der erste nicht zum Ziel führt.",
    "fr": "Ma grand-mère avait un petit jardin derrière la maison, et chaque printemps elle plantait des haricots, des carottes et une longue rangée d'oignons. Quand nous étions enfants, nous l'aidions à porter l'eau du puits, bien que la plus grande partie finisse dans nos chaussures. Le train part à sept heures et demie, il faut donc être à la gare avant. Je n'ai jamais vu autant de monde au marché ; les gens étaient venus de tous les villages autour du lac. Elle disait qu'il n'y avait pas de quoi s'inquiéter, parce que le médecin avait déjà regardé son bras. S'il pleut demain, les enfants resteront chez eux pour lire. Laquelle de ces deux routes mène au port ? Il ne savait plus où il avait posé ses lunettes, puisqu'il pensait toujours à autre chose. La maîtresse a demandé à chacun d'écrire ce qu'il avait appris pendant l'année. Il y a beaucoup de raisons pour lesquelles le pain est meilleur quand il cuit lentement, mais la plus importante est le temps. Ils étaient fatigués après cette longue marche, pourtant personne ne voulait aller se coucher. Mes deux frères travaillent dans le nord, où les hivers sont sombres et où la neige reste des mois. Il ne suffit pas de connaître les règles du jeu, on doit aussi savoir quand elles ne valent pas. Pourriez-vous fermer la fenêtre ? D'après ce que nous savons, le pont a été construit il y a environ trois cents ans par des ouvriers qui ne recevaient guère plus qu'une soupe et un lit. Cette image montre la ville telle qu'elle était. Tous les êtres humains naissent libres et égaux en dignité et en droits et doivent agir les uns envers les autres dans un esprit de fraternité. Seuls quelques visiteurs ont remarqué que l'horloge s'était arrêtée. Selon la lettre arrivée lundi, la réunion aura lieu un autre jour. Sans musique, la soirée aurait été plutôt ennuyeuse, cependant le repas nous a plu.",
    "es": "Mi abuela tenía un pequeño huerto detrás de la casa, y cada primavera plantaba judías, zanahorias y una larga hilera de cebollas. Cuando éramos niños la ayudábamos a llevar agua del pozo, aunque la mayor parte acababa en nuestros zapatos. El tren sale a las siete y media, así que deberías estar antes en la estación. Nunca he visto tanta gente en el mercado; habían venido de todos los pueblos que rodean el lago. Ella decía que no había de qué preocuparse, porque el médico ya le había mirado el brazo. Si mañana llueve, los niños se quedarán en casa leyendo. ¿Cuál de estos dos caminos lleva al puerto? No recordaba dónde había dejado las gafas, pues siempre estaba pensando en otra cosa. La maestra pidió a cada uno que escribiera lo que había aprendido durante el año. Hay muchas razones por las que el pan sabe mejor cuando se hornea despacio, pero la más importante es el tiempo. Estaban cansados después de la caminata, sin embargo nadie quería irse a dormir. Mis dos hermanos trabajan en el norte, donde los inviernos son oscuros y la nieve dura meses. No basta con conocer las reglas del juego, también hay que saber cuándo no valen. ¿Podría usted cerrar la ventana? Según parece, el puente fue construido hace unos trescientos años por obreros que recibían poco más que una sopa y un sitio para dormir. Esta imagen muestra la ciudad como era antes. Todos los seres humanos nacen libres e iguales en dignidad y derechos y deben comportarse fraternalmente los unos con los otros. Pocos visitantes notaron que el reloj se había parado. De acuerdo con la carta que llegó el lunes, la reunión será otro día. Sin música la noche habría sido más bien aburrida, no obstante nos gustó la comida.",
    "it": "Mia nonna aveva un piccolo orto dietro la casa e ogni primavera piantava fagioli, carote e una lunga fila di cipolle. Quando eravamo bambini la aiutavamo a portare l'acqua dal pozzo, anche se la maggior parte finiva nelle nostre scarpe. Il treno parte alle sette e mezza, perciò dovresti essere alla stazione prima. Non ho mai visto tanta gente al mercato; erano venuti da tutti i paesi intorno al lago. Diceva che non c'era nulla di cui preoccuparsi, perché il medico gli aveva già guardato il braccio. Se domani piove, i bambini resteranno a casa a leggere. Quale di queste due strade porta al porto? Non ricordava più dove aveva messo gli occhiali, poiché pensava sempre ad altro. La maestra chiese a ciascuno di scrivere quello che aveva imparato durante l'anno. Ci sono molte ragioni per cui il pane è più buono quando cuoce lentamente, ma la più importante è il tempo. Erano stanchi dopo la lunga passeggiata, eppure nessuno voleva andare a dormire. I miei due fratelli lavorano al nord, dove gli inverni sono bui e la neve rimane per mesi. Non basta conoscere le regole del gioco, bisogna anche sapere quando non valgono. Potrebbe chiudere la finestra? Per quanto sappiamo, il ponte fu costruito circa trecento anni fa da operai che ricevevano poco più di una minestra. Questa immagine mostra la città com'era una volta. Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti e devono agire gli uni verso gli altri in spirito di fratellanza. Solo pochi visitatori si accorsero che l'orologio si era fermato. Secondo la lettera arrivata lunedì la riunione si terrà un altro giorno. Senza musica la serata sarebbe stata piuttosto noiosa, tuttavia la cena ci è piaciuta.",
    "pt": "A minha avó tinha uma pequena horta atrás da casa e em cada primavera plantava feijão, cenouras e uma longa fila de cebolas. Quando éramos crianças ajudávamos a levar água do poço, embora a maior parte acabasse nos nossos sapatos. O comboio parte às sete e meia, por isso você deve estar antes na estação. Nunca vi tanta gente na feira; tinham vindo de todas as aldeias à volta do lago. Ela dizia que não havia motivo de preocupação, porque o médico já lhe tinha visto o braço. Se amanhã chover, as crianças ficarão em casa a ler. Qual destas duas estradas vai para o porto? Não se lembrava onde tinha posto os óculos, pois estava sempre a pensar noutra coisa. A professora pediu a cada um que escrevesse o que tinha aprendido durante o ano. Há muitas razões para que o pão seja melhor quando é cozido devagar, mas a mais importante é o tempo. Estavam cansados depois da longa caminhada, contudo ninguém queria ir dormir. Os meus dois irmãos trabalham no norte, onde os invernos são escuros e a neve dura meses. Não basta conhecer as regras do jogo, também é preciso saber quando não valem. Poderia fechar a janela? Segundo se sabe, a ponte foi construída há cerca de trezentos anos por operários que recebiam pouco mais do que uma sopa. Esta imagem mostra a cidade como era antigamente. Todos os seres humanos nascem livres e iguais em dignidade e em direitos e devem agir uns para com os outros em espírito de fraternidade. Somente alguns visitantes notaram que o relógio tinha parado. Sem música a noite teria sido um tanto aborrecida, no entanto gostamos da refeição. Então não pudemos fazer mais nada além de esperar.",
    "nl": "Mijn grootmoeder had een kleine tuin achter het huis en elk voorjaar plantte ze bonen, wortels en een lange rij uien. Toen we kinderen waren hielpen we haar met water dragen uit de put, hoewel het meeste daarvan in onze schoenen terechtkwam. De trein vertrekt om half acht, dus je moet daarvoor op het station zijn. Ik heb nog nooit zoveel mensen op de markt gezien; ze kwamen uit alle dorpen rond het meer. Ze zei dat er niets was om je zorgen over te maken, omdat de dokter al naar zijn arm had gekeken. Als het morgen regent, blijven de kinderen thuis en gaan ze lezen. Welke van deze twee wegen gaat naar de haven? Hij wist niet meer waar hij zijn bril had neergelegd, want hij dacht altijd aan iets anders. De juf vroeg iedereen op te schrijven wat er dat jaar geleerd was. Er zijn veel redenen waarom brood beter smaakt wanneer het langzaam gebakken wordt, maar de belangrijkste is tijd. Ze waren moe na de lange wandeling, toch wilde niemand naar bed. Mijn beide broers werken in het noorden, waar de winters donker zijn en de sneeuw maanden blijft liggen. Het is niet genoeg om de regels van het spel te kennen, men moet ook weten wanneer ze niet gelden. Zou u het raam willen sluiten? Voor zover bekend werd de brug ongeveer driehonderd jaar geleden gebouwd door arbeiders die weinig meer kregen dan soep. Dit schilderij toont de stad zoals zij vroeger was. Alle mensen worden vrij en gelijk in waardigheid en rechten geboren en behoren zich jegens elkander in een geest van broederschap te gedragen. Slechts enkele bezoekers merkten dat de klok stilstond. Zonder muziek zou de avond nogal saai zijn geweest, maar het eten vonden wij lekker.",
    "sv": "Min mormor hade en liten trädgård bakom huset, och varje vår planterade hon bönor, morötter och en lång rad lökar. När vi var barn hjälpte vi henne att bära vatten från brunnen, fast det mesta hamnade i våra skor. Tåget går klockan halv åtta, så du bör vara på stationen innan dess. Jag har aldrig sett så mycket folk på torget; de kom från alla byar runt sjön. Hon sade att det inte fanns något att oroa sig för, eftersom läkaren redan hade tittat på armen. Om det regnar i morgon stannar barnen hemma och läser. Vilken av de här två vägarna leder till hamnen? Han mindes inte var han hade lagt sina glasögon, för han tänkte alltid på något annat. Läraren bad var och en att skriva ned vad de hade lärt sig under året. Det finns många skäl till att bröd smakar bättre när det gräddas långsamt, men det viktigaste är tiden. De var trötta efter den långa promenaden, ändå ville ingen gå och lägga sig. Alla människor är födda fria och lika i värde och rättigheter och bör handla gentemot varandra i en anda av broderskap.",
    "da": "Min mormor havde en lille have bag huset, og hvert forår plantede hun bønner, gulerødder og en lang række løg. Da vi var børn, hjalp vi hende med at bære vand fra brønden, selv om det meste endte i vores sko. Toget kører klokken halv otte, så du bør være på stationen inden da. Jeg har aldrig set så mange mennesker på torvet; de kom fra alle landsbyerne omkring søen. Hun sagde, at der ikke var noget at være bekymret for, fordi lægen allerede havde set på armen. Hvis det regner i morgen, bliver børnene hjemme og læser. Hvilken af disse to veje fører til havnen? Han kunne ikke huske, hvor han havde lagt sine briller, for han tænkte altid på noget andet. Læreren bad hver af dem om at skrive ned, hvad de havde lært i årets løb. Alle mennesker er født frie og lige i værdighed og rettigheder og bør handle mod hverandre i en broderskabets ånd.",
    "fi": "Isoäidilläni oli pieni puutarha talon takana, ja joka kevät hän istutti papuja, porkkanoita ja pitkän rivin sipuleita. Kun olimme lapsia, autoimme häntä kantamaan vettä kaivosta, vaikka suurin osa päätyi kenkiimme. Juna lähtee puoli kahdeksalta, joten sinun pitäisi olla asemalla ennen sitä. En ole koskaan nähnyt niin paljon ihmisiä torilla; he olivat tulleet kaikista järven ympärillä olevista kylistä. Hän sanoi, ettei ollut mitään syytä huoleen, koska lääkäri oli jo katsonut kättä. Jos huomenna sataa, lapset jäävät kotiin lukemaan. Kumpi näistä kahdesta tiestä vie satamaan? Hän ei muistanut, mihin oli pannut silmälasinsa, sillä hän ajatteli aina jotain muuta. Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "pl": "Moja babcia miała mały ogród za domem i każdej wiosny sadziła fasolę, marchew oraz długi rząd cebuli. Kiedy byliśmy dziećmi, pomagaliśmy jej nosić wodę ze studni, chociaż większość lądowała w naszych butach. Pociąg odjeżdża o wpół do ósmej, więc powinieneś być wcześniej na dworcu. Nigdy nie widziałem tylu ludzi na rynku; przyszli ze wszystkich wsi wokół jeziora. Mówiła, że nie ma się czym martwić, ponieważ lekarz już obejrzał jego rękę. Jeśli jutro będzie padać, dzieci zostaną w domu i będą czytać. Która z tych dwóch dróg prowadzi do portu? Nie pamiętał, gdzie położył okulary, bo zawsze myślał o czymś innym. Nauczycielka poprosiła każdego, aby zapisał, czego się nauczył w ciągu roku. Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw i powinni postępować wobec innych w duchu braterstwa.",
    "cs": "Moje babička měla za domem malou zahradu a každé jaro sázela fazole, mrkev a dlouhou řadu cibule. Když jsme byli děti, pomáhali jsme jí nosit vodu ze studny, i když většina skončila v našich botách. Vlak odjíždí v půl osmé, takže bys měl být na nádraží dříve. Nikdy jsem neviděl na trhu tolik lidí; přišli ze všech vesnic kolem jezera. Říkala, že se není čeho bát, protože lékař už mu ruku prohlédl. Jestli bude zítra pršet, děti zůstanou doma a budou si číst. Která z těchto dvou cest vede do přístavu? Nepamatoval si, kam položil brýle, neboť vždycky myslel na něco jiného. Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv a mají spolu jednat v duchu bratrství.",
    "hu": "Nagyanyámnak volt egy kis kertje a ház mögött, és minden tavasszal babot, répát meg egy hosszú sor hagymát ültetett. Amikor gyerekek voltunk, segítettünk neki vizet hordani a kútról, bár a legtöbb a cipőnkbe került. A vonat fél nyolckor indul, ezért előbb kell az állomáson lenned. Soha nem láttam még ennyi embert a piacon; a tó körüli összes faluból jöttek. Azt mondta, hogy nincs miért aggódni, mert az orvos már megnézte a karját. Ha holnap esik az eső, a gyerekek otthon maradnak és olvasnak. Minden emberi lény szabadon születik és egyenlő méltósága és joga van, egymással szemben testvéri szellemben kell hogy viseltessenek.",
    "ro": "Bunica mea avea o grădină mică în spatele casei și în fiecare primăvară planta fasole, morcovi și un rând lung de ceapă. Când eram copii o ajutam să care apă de la fântână, deși cea mai mare parte ajungea în pantofii noștri. Trenul pleacă la șapte și jumătate, așa că ar trebui să fii la gară înainte. Nu am văzut niciodată atâta lume la piață; veniseră din toate satele din jurul lacului. Ea spunea că nu există niciun motiv de îngrijorare, pentru că doctorul îi văzuse deja brațul. Dacă mâine plouă, copiii vor rămâne acasă și vor citi. Toate ființele umane se nasc libere și egale în demnitate și în drepturi și trebuie să se comporte unele față de altele în spiritul fraternității.",
    "tr": "Büyükannemin evin arkasında küçük bir bahçesi vardı ve her ilkbaharda fasulye, havuç ve uzun bir sıra soğan dikerdi. Çocukken kuyudan su taşımasına yardım ederdik, ama çoğu ayakkabılarımızın içine dökülürdü. Tren yedi buçukta kalkıyor, bu yüzden daha önce istasyonda olmalısın. Pazarda hiç bu kadar çok insan görmemiştim; gölün çevresindeki bütün köylerden gelmişlerdi. Endişelenecek bir şey olmadığını söyledi, çünkü doktor koluna zaten bakmıştı. Yarın yağmur yağarsa çocuklar evde kalıp kitap okuyacaklar. Bütün insanlar özgür, onur ve haklar bakımından eşit doğarlar ve birbirlerine karşı kardeşlik anlayışıyla davranmalıdırlar.",
    "id": "Nenek saya memiliki kebun kecil di belakang rumah, dan setiap musim semi ia menanam kacang, wortel, serta sebaris panjang bawang. Ketika kami masih anak-anak, kami membantunya mengangkat air dari sumur, meskipun sebagian besar tumpah ke sepatu kami. Kereta berangkat pukul setengah delapan, jadi kamu harus berada di stasiun sebelum itu. Saya belum pernah melihat begitu banyak orang di pasar; mereka datang dari semua desa di sekitar danau. Katanya tidak ada yang perlu dikhawatirkan, karena dokter sudah memeriksa lengannya. Jika besok hujan, anak-anak akan tinggal di rumah dan membaca. Semua orang dilahirkan merdeka dan mempunyai martabat dan hak yang sama, dan hendaknya satu sama lain bergaul dalam semangat persaudaraan.",
    "vi": "Bà tôi có một khu vườn nhỏ phía sau nhà, và mỗi mùa xuân bà trồng đậu, cà rốt và một hàng hành dài. Khi còn nhỏ chúng tôi giúp bà gánh nước từ giếng, mặc dù phần lớn đổ vào giày của chúng tôi. Tàu chạy lúc bảy giờ rưỡi, vì vậy bạn nên đến ga trước đó. Tôi chưa bao giờ thấy nhiều người ở chợ như thế; họ đến từ tất cả các làng quanh hồ. Bà nói rằng không có gì phải lo, bởi vì bác sĩ đã xem cánh tay của anh ấy rồi. Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi, và phải đối xử với nhau trong tình bác ái.",
    "ru": "У моей бабушки за домом был маленький огород, и каждую весну она сажала фасоль, морковь и длинный ряд лука. Когда мы были детьми, мы помогали ей носить воду из колодца, хотя большая часть оказывалась в наших ботинках. Поезд отправляется в половине восьмого, поэтому тебе следует быть на вокзале раньше. Я никогда не видел столько людей на рынке; они пришли из всех деревень вокруг озера. Она говорила, что беспокоиться не о чем, потому что врач уже осмотрел его руку. Если завтра пойдёт дождь, дети останутся дома и будут читать. Какая из этих двух дорог ведёт в гавань? Он не мог вспомнить, куда положил очки, ведь он всегда думал о чём-то другом. Учительница попросила каждого записать то, чему он научился за год. Насколько известно, мост был построен около трёхсот лет назад рабочими, которые получали немногим больше супа. Все люди рождаются свободными и равными в своём достоинстве и правах и должны поступать в отношении друг друга в духе братства. Лишь немногие посетители заметили, что часы остановились. Это не значит, что другого пути нет, однако искать его придётся долго.",
    "uk": "У моєї бабусі за хатою був маленький город, і щовесни вона садила квасолю, моркву та довгий ряд цибулі. Коли ми були дітьми, ми допомагали їй носити воду з криниці, хоча більша частина опинялася в наших черевиках. Потяг вирушає о пів на восьму, тому тобі слід бути на вокзалі раніше. Я ніколи не бачив стільки людей на ринку; вони прийшли з усіх сіл навколо озера. Вона казала, що хвилюватися нема чого, бо лікар уже оглянув його руку. Якщо завтра піде дощ, діти залишаться вдома й читатимуть. Котра з цих двох доріг веде до гавані? Всі люди народжуються вільними і рівними у своїй гідності та правах і повинні діяти у відношенні один до одного в дусі братерства.",
    "bg": "Баба ми имаше малка градина зад къщата и всяка пролет садеше фасул, моркови и един дълъг ред лук. Когато бяхме деца, ѝ помагахме да носи вода от кладенеца, макар че повечето се озоваваше в обувките ни. Влакът тръгва в седем и половина, затова трябва да бъдеш на гарата преди това. Никога не съм виждал толкова хора на пазара; те бяха дошли от всички села около езерото. Тя каза, че няма за какво да се тревожим, защото лекарят вече беше прегледал ръката му. Всички хора се раждат свободни и равни по достойнство и права и следва да се отнасят помежду си в дух на братство.",
}
#: The language that a script stands for where it has no model of its own.
SCRIPTS = {"CJK": "zh", "HIRAGANA": "ja", "KATAKANA": "ja", "HANGUL": "ko", "GREEK": "el", "ARABIC": "ar", "HEBREW": "he", "DEVANAGARI": "hi", "THAI": "th"}
_LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CODED = re.compile(r"\S*\d\S*")
_SMOOTH = 0.05
#: Mean log-likelihood of an n-gram below which a text fits no model.
LEAST_FIT = -8.8


@lru_cache(maxsize=1 << 17)
def script(letter: str) -> str:
    """The script of a letter by its Unicode name, in capitals."""
    name = unicodedata.name(letter, "OTHER").split()[0]
    return "LATIN" if name in ("FULLWIDTH", "MODIFIER", "FEMININE", "MASCULINE") else name


def _script_of(words: Counter) -> str | None:
    """The script most letters are in; any share of kana above a tenth makes Japanese."""
    found: Counter = Counter()
    for w, n in words.items():
        if w.isascii():
            found["LATIN"] += n * len(w)
        else:
            for c in w:
                if c.isalpha():
                    found[script(c)] += n
    if not found:
        return None
    kana = found["HIRAGANA"] + found["KATAKANA"]
    if kana > 0.1 * sum(found.values()):
        return "HIRAGANA"
    return max(found, key=found.get)


def _word_grams(low: str) -> list[str]:
    """1- to 3-grams of a word between blanks; short words, which carry grammar, count as a whole twice more."""
    padded = f" {low} "
    found = [padded[i : i + n] for n in (1, 2, 3) for i in range(n == 1, len(padded) - n + 1 - (n == 1))]
    return found + [padded] * 2 if len(low) <= 5 else found


@lru_cache(maxsize=1)
def model() -> tuple[dict[str, int], np.ndarray]:
    """Row of each n-gram in a table of log-probabilities, a column per language; the last row is for unseen ones."""
    counted = [Counter(g for w in _LETTERS.findall(text.lower()) for g in _word_grams(w)) for text in SAMPLES.values()]
    row = {g: i for i, g in enumerate(sorted(set().union(*counted)))}
    table = np.full((len(row) + 1, len(counted)), _SMOOTH)
    for k, c in enumerate(counted):
        for g, n in c.items():
            table[row[g], k] += n
    return row, np.log(table / table.sum(axis=0))


@lru_cache(maxsize=1)
def script_of_model() -> dict[str, str]:
    return {lang: _script_of(Counter(_LETTERS.findall(text.lower()))) for lang, text in SAMPLES.items()}


@lru_cache(maxsize=200_000)
def _word_scores(word: str) -> np.ndarray:
    """Log-likelihood of a word per language, and how many n-grams it has."""
    row, table = model()
    own = [g for w in _LETTERS.findall(word) for g in _word_grams(w)]
    return np.append(table[[row.get(g, -1) for g in own]].sum(axis=0), len(own))


def words_of(text: str) -> Counter:
    """Lower-cased words without digits and their counts."""
    return Counter(_LETTERS.findall((_CODED.sub(" ", text) if any(c.isdigit() for c in text) else text).lower()))


def detect(words: Counter, drop: frozenset[str] = frozenset()) -> tuple[str | None, dict[str, float], int]:
    """The likeliest language, log-likelihoods of all languages (equal priors) and the number of n-grams they rest on.

    Words in `drop` do not count. None without letters; a script without a model names its language, or itself in lower
    case; `unknown` is a text that none of the models of its script fits.
    """
    kept = [(w, n) for w, n in words.items() if w not in drop]
    where = _script_of(Counter(dict(kept)))
    if where is None:
        return None, dict.fromkeys(SAMPLES, 0.0), 0
    totals = np.fromiter((n for _, n in kept), float, len(kept)) @ np.array([_word_scores(w) for w, _ in kept])
    made, n = dict(zip(SAMPLES, totals.tolist(), strict=False)), int(totals[-1])
    own = [lang for lang, s in script_of_model().items() if s == where]
    if not own:
        return SCRIPTS.get(where, where.lower()), made, n
    best = max(own, key=made.get)
    return (best if made[best] >= LEAST_FIT * n else "unknown"), made, n
