"""Stop words of the language analyzers.

Fixed values: the published default lists, in their order.  The longer lists of other languages are parameters.
"""

GERMAN = tuple("""
einer eine eines einem einen der die das dass daß du er sie es was wer wie wir und oder ohne mit am im in aus auf
ist sein war wird ihr ihre ihres als für von dich dir mich mir mein kein durch wegen
""".split())

DUTCH = tuple("""
de en van ik te dat die in een hij het niet zijn is was op aan met als voor had er maar om hem dan zou of wat mijn
men dit zo door over ze zich bij ook tot je mij uit der daar haar naar heb hoe heeft hebben deze u want nog zal me
zij nu ge geen omdat iets worden toch al waren veel meer doen toen moet ben zonder kan hun dus alles onder ja eens
hier wie werd altijd doch wordt wezen kunnen ons zelf tegen na reeds wil kon niets uw iemand geweest andere
""".split())

BRAZILIAN = tuple("""
a ainda alem ambas ambos antes ao aonde aos apos aquele aqueles as assim com como contra contudo cuja cujas cujo
cujos da das de dela dele deles demais depois desde desta deste dispoe dispoem diversa diversas diversos do dos
durante e ela elas ele eles em entao entre essa essas esse esses esta estas este estes ha isso isto logo mais mas
mediante menos mesma mesmas mesmo mesmos na nas nao nem nesse neste nos o os ou outra outras outro outros pelas pelo
pelos perante pois por porque portanto proprio propios quais qual qualquer quando quanto que quem quer se seja sem
sendo seu seus sob sobre sua suas tal tambem teu teus toda todas todo todos tua tuas tudo um uma umas uns
""".split())

RUSSIAN = tuple("""
а без более бы был была были было быть в вам вас весь во вот все всего всех вы где да даже для до его ее ей ею если
есть еще же за здесь и из или им их к как ко когда кто ли либо мне может мы на надо наш не него нее нет ни них но ну
о об однако он она они оно от очень по под при с со так также такой там те тем то того тоже той только том ты у уже
хотя чего чей чем что чтобы чье чья эта эти это я
""".split())

CZECH = tuple("""
a s k o i u v z dnes cz tímto budeš budem byli jseš muj svým ta tomto tohle tuto tyto jej zda proc máte tato kam
tohoto kdo kterí mi nám tom tomuto mít nic proto kterou byla toho protože asi ho naši napište re což tím takže svých
její svými jste aj tu tedy teto bylo kde ke pravé ji nad nejsou ci pod téma mezi pres ty pak vám ani když však neg
jsem tento clánku clánky aby jsme pred pta jejich byl ješte až bez také pouze první vaše která nás nový tipy pokud
muže strana jeho své jiné zprávy nové není vás jen podle zde už být více bude již než který by které co nebo ten tak
má pri od po jsou jak další ale si se ve to jako za zpet ze do pro je na atd atp jakmile pricemž já on ona ono oni
ony my vy jí me mne jemu tomu tem temu nemu nemuž jehož jíž jelikož jež jakož nacež
""".split())

ARABIC = tuple("""
من ومن منها منه في وفي فيها فيه و ف ثم او أو ب بها به ا أ اى اي أي أى لا ولا الا ألا إلا لكن ما وما كما فما عن مع
اذا إذا ان أن إن انها أنها إنها انه أنه إنه بان بأن فان فأن وان وأن وإن التى التي الذى الذي الذين الى الي إلى إلي
على عليها عليه اما أما إما ايضا أيضا كل وكل لم ولم لن ولن هى هي هو وهى وهي وهو فهى فهي فهو انت أنت لك لها له هذه هذا
تلك ذلك هناك كانت كان يكون تكون وكانت وكان غير بعض قد نحو بين بينما منذ ضمن حيث الان الآن خلال بعد قبل حتى عند عندما
لدى جميع
""".split())

GREEK = tuple("""
ο η το οι τα του τησ των τον την και κι κ ειμαι εισαι ειναι ειμαστε ειστε στο στον στη στην μα αλλα απο για προσ με
σε ωσ παρα αντι κατα μετα θα να δε δεν μη μην επι ενω εαν αν τοτε που πωσ ποιοσ ποια ποιο ποιοι ποιεσ ποιων ποιουσ
αυτοσ αυτη αυτο αυτοι αυτων αυτουσ αυτεσ αυτα εκεινοσ εκεινη εκεινο εκεινοι εκεινεσ εκεινα εκεινων εκεινουσ οπωσ
ομωσ ισωσ οσο οτι
""".split())

FRENCH = tuple("""
a afin ai ainsi après attendu au aujourd auquel aussi autre autres aux auxquelles auxquels avait avant avec avoir c
car ce ceci cela celle celles celui cependant certain certaine certaines certains ces cet cette ceux chez ci combien
comme comment concernant contre d dans de debout dedans dehors delà depuis derrière des désormais desquelles
desquels dessous dessus devant devers devra divers diverse diverses doit donc dont du duquel durant dès elle elles
en entre environ est et etc etre eu eux excepté hormis hors hélas hui il ils j je jusqu jusque l la laquelle le
lequel les lesquelles lesquels leur leurs lorsque lui là ma mais malgré me merci mes mien mienne miennes miens moi
moins mon moyennant même mêmes n ne ni non nos notre nous néanmoins nôtre nôtres on ont ou outre où par parmi
partant pas passé pendant plein plus plusieurs pour pourquoi proche près puisque qu quand que quel quelle quelles
quels qui quoi quoique revoici revoilà s sa sans sauf se selon seront ses si sien sienne siennes siens sinon soi
soit son sont sous suivant sur ta te tes tien tienne tiennes tiens toi ton tous tout toute toutes tu un une va vers
voici voilà vos votre vous vu vôtre vôtres y à ça ès été être ô
""".split())
