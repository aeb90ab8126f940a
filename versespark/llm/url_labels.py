"""A small labelled table of invented urls, which the URL filter is trained on: hosts and paths of the kinds that crawls
keep (news, reference, schools, shops of record, personal pages) and of the kinds that they drop (gambling, pills, adult
pages, loans, fake downloads, sign-in traps, trackers, link farms)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ALLOWED = """
morningherald.example.com /world/2021/harvest-report
morningherald.example.com /sport/results
citygazette.example.net /politics/council-meets
citygazette.example.net /archive/1998/03
rivertimes.example.org /culture/festival-opens
weeklyobserver.example.com /opinion/letters
weeklyobserver.example.com /science/new-telescope
radiostation.example.org /programmes/evening-concert
encyclopedia.example.org /wiki/photosynthesis
encyclopedia.example.org /wiki/history-of-printing
dictionary.example.net /entry/lantern
atlas.example.org /maps/rivers/danube
grammarbook.example.com /lessons/past-tense
library.example.edu /catalogue/manuscripts
library.example.edu /opening-hours
university.example.edu /departments/physics
university.example.edu /admissions/guide
school.example.org /timetable/autumn
museum.example.org /exhibitions/ceramics
museum.example.org /visit/tickets
observatory.example.edu /papers/2019/variable-stars
healthservice.example.gov /vaccines/schedule
healthservice.example.gov /advice/fever
ministry.example.gov /forms/passport
townhall.example.gov /waste/collection-days
court.example.gov /judgments/2015/114
parliament.example.gov /debates/2020-06-11
weather.example.gov /forecast/coast
railway.example.com /timetables/north-line
ferry.example.net /routes/islands
gardenclub.example.org /articles/pruning-roses
gardenclub.example.org /events/spring-fair
recipes.example.com /bread/sourdough-rye
recipes.example.com /soups/lentil
cookery.example.net /techniques/braising
hiking.example.org /trails/ridge-walk
birdwatch.example.org /species/wren
astronomy.example.net /guide/binoculars
chessclub.example.org /games/2004/round-3
poetry.example.org /collections/winter
folksongs.example.net /texts/spinning-song
translations.example.org /de/fabeln
translations.example.org /fr/contes
documents.example.net /es/cuentos/17
pages.example.net /en/4821
pages.example.com /en/1290
blog.example.net /2017/08/repairing-a-bicycle
blog.example.com /2012/11/notes-on-sailing
diary.example.org /en/2207
notes.example.edu /lectures/algebra/7
manuals.example.com /printer/setup
docs.example.net /reference/functions
docs.example.net /tutorial/first-steps
source.example.org /projects/compiler/readme
forum.example.org /threads/tuning-a-piano
forum.example.net /threads/811
history.example.org /battles/1815
genealogy.example.net /families/miller
theatre.example.com /season/2022
orchestra.example.org /concerts/march
bookshop.example.com /novels/sea-stories
stamps.example.net /catalogue/1890
woodwork.example.com /joints/dovetail
knitting.example.org /patterns/scarf
"""

BLOCKED = """
casino-royal.example.com /play-now/slots
casino-bonus.example.net /free-spins
lucky-slots.example.net /bonus/jackpot
poker-win.example.com /register?bonus=200
betting-tips.example.net /sure-win/odds
online-casino.example.org /jackpot/play
bet-bonus.example.com /free-bet/now
cheap-pills.example.com /buy-viagra-online
cheap-meds.example.net /no-prescription/pills
pharmacy-discount.example.com /buy-cheap-cialis
diet-pills.example.net /lose-weight-fast
miracle-pills.example.org /buy-now/offer
xxx-videos.example.com /free-porn/watch
adult-cams.example.net /live-sex/chat
hot-singles.example.com /adult-dating/join
porn-tube.example.net /xxx/free
sex-dating.example.org /hot-girls/join-now
nude-pics.example.com /xxx/gallery
payday-loans.example.com /apply-now/fast-cash
quick-cash.example.net /loans/no-credit-check
bad-credit-loans.example.com /instant-approval
easy-money.example.org /earn-cash-fast
make-money-fast.example.net /get-rich/now
crypto-doubler.example.com /invest-now/double
forex-profit.example.net /guaranteed/earn
free-download.example.com /crack/keygen.exe
warez-crack.example.net /full-version/keygen
serial-keys.example.org /download/crack
movie-free-download.example.com /torrent/watch-now
driver-update.example.net /download-now/setup.exe
prize-winner.example.com /claim-prize/now
free-gift-cards.example.net /claim/winner
you-won.example.org /prize/claim-now
secure-login-verify.example.com /account/signin/confirm
account-verify.example.net /login/update-password
bank-secure-login.example.org /verify/account
signin-confirm.example.com /secure/login.php
paypal-verify.example.net /webscr/login
ads-tracker.example.com /click?aff=77
click-ads.example.net /redirect?aff=12
banner-ads.example.org /adserver/click
track-click.example.com /pixel/redirect
pop-ads.example.net /popunder/click
link-exchange.example.com /links/seo-backlinks
seo-backlinks.example.net /buy-links/cheap
article-spinner.example.org /seo/traffic-bot
buy-followers.example.com /cheap-likes
cheap-watches.example.net /replica/buy-now
replica-bags.example.com /buy-cheap/outlet
outlet-discount.example.org /replica/cheap-shoes
fake-id.example.net /buy-now/passport-replica
hacked-accounts.example.com /buy/cheap-accounts
essay-cheap.example.net /buy-essay-now
free-xxx.example.org /adult/videos
slots-jackpot.example.com /free-spins/bonus
casino-live.example.org /bonus/register
cheap-viagra.example.org /pills/discount
loans-instant.example.net /fast-cash/apply
adult-webcam.example.com /xxx/live
win-cash.example.net /prize/jackpot
crack-games.example.com /keygen/download
verify-secure.example.net /signin/account-update
click-bonus.example.org /aff/redirect
hot-cams.example.net /sex/live-chat
"""


def labelled_urls(spark: SparkSession) -> DataFrame:
    """host, path, blocked (0/1)."""
    rows = [(*line.split(" "), blocked) for text, blocked in ((ALLOWED, 0), (BLOCKED, 1)) for line in text.split("\n") if line]
    return spark.createDataFrame(rows, "host string, path string, blocked int")
