"""Sentences written by hand, with personal data between double braces, as kind|text; it shares nothing with the generator."""

SENTENCES = r"""
Reach Maria under {{email|maria.lopez [at] clinic [dot] org}} before Friday.
My work address is {{email|t.becker(at)stadtwerke(dot)de}}, the private one follows.
Please send invoices to {{email|billing at northwind dot com}} and nowhere else.
Her handle is {{email|sue dot ellen at ranch dot net}} if you must know.
Contact: {{email|info[@]museum[.]org}}
You can write {{email|p_k_dick {at} ubik {dot} io}} today
It went to {{email|office @ harbour.co.uk}} last week
{{email|kim42 <at> seoul <dot> net}} is the one I use
old: {{email|a.b.c.d.e.f.g.h.i.j.k.l.m.n.o.p@longhost[.]com}}
The editor ({{email|ed.itor [at] paper.fr}}) wants it shorter.
questions? {{email|help AT desk DOT com}}
Write {{email|jean-luc.martin (at) mairie.paris (dot) fr}} for the permit.
Ask {{email|noreply+tag [at] shop [dot] com}} again
Mail me: {{email|r2d2 at droids dot org}}.
I use {{email|first.last@mail(dot)com}} for work.
Reply to {{email|lena   [at]   post   [dot]   de}} please
{{email|bob [ at ] site [ dot ] net}} has left the group
The owner, {{email|x@y[dot]org}}, sold it.
Card no. {{card|4111.1111.1111.1111}} was declined.
Paid with {{card|5500_0000_0000_0004}} in May
The number {{card|4012 / 8888 / 8888 / 1881}} is on file.
visa {{card|4111  1111  1111  1111}} exp 12/29
credit card {{card|3782.822463.10005}} from the trip
He wrote {{card|4 - 1 - 1 - 1 - 1 - 1 - 1 - 1 - 1 - 1 - 1 - 1 - 1 - 1 - 1 - 1}} on a napkin
mastercard: {{card|5555/5555/5555/4444}}
payment by {{card|6011 .... 1111 .... 1111 .... 1117}} failed
my card is
{{card|4012
8888
8888
1881}}
card {{card|4222/2222/2222/2}} is too short to be new
Use {{card|5105 -- 1051 -- 0510 -- 5100}} instead.
the credit card {{card|4111*1111*1111*1111}} again
Call {{phone|(212) 555-0147}} after six.
Tel. {{phone|030 / 901820}} or fax below
phone {{phone|0044 20 7946 0958}} for the London desk
Mobile: {{phone|0171 2345678}}
Phone {{phone|+49 (0) 30 / 1234567}} in the morning
Fax {{phone|(089) 2180-0}} is dead
You can call {{phone|555-867-5309}} for a good time.
call {{phone|01 42 68 53 00}} in Paris
telephone {{phone|+1/415/5550132}} west coast
My number: phone {{phone|617.555.0123}}
Ring us, tel {{phone|00 33 1 42 68 53 00}}.
mobile {{phone|06-12-34-56-78}} at any hour
call us at {{phone|1-800-555-0199}} today
tel: {{phone|(020) 7946 0018}}
phone: {{phone|0030 210 3214567}}
fax {{phone|(+44) 161 496 0000}}
Phone {{phone|+39 / 06 / 69812345}} for the tour
Tel {{phone|0 30 - 12 34 56 7}} is the old one
The host {{ip|192[.]168[.]10[.]15}} scanned us.
Block {{ip|10 . 20 . 30 . 40}} at the edge.
server {{ip|8(.)8(.)4(.)4}} answers slowly
traffic from {{ip|172 dot 16 dot 254 dot 1}} rose
login by {{ip|203[dot]0[dot]113[dot]77}} at night
ping {{ip|1[.]1[.]1[.]1}} and wait
address {{ip|198 .51 .100 .23}} is free
{{ip|127 [dot] 0 [dot] 0 [dot] 1}} is home
the ip {{ip|10.0.0[.]7}} was seen
We were at home dot painting all day.
Meet me at noon, the dot on the map is the place.
He looked at the sign and left.
Tickets are 3 @ 5 dollars each.
The score was 3 - 2, then 4 - 4, then 5 - 4.
Founded in 1871, rebuilt 1899, closed 1945, sold 1990.
ISBN 978-3-16-148410-0 is in print.
ISBN 978-0-306-40615-7 is not.
Born 1984-03-12 09:45 in Leeds.
The meeting is on 12.03.2024 and 14.03.2024.
Version 4.2.1 replaced 4.2.0 and 4.1.9.
Revenue grew from 1,234,567.89 to 2,345,678.90.
Pi is 3.14159265358979 and e is 2.718281828459.
Chapter 1 ........ 12
Chapter 2 ........ 34
Chapter 3 ........ 57
Rows: 12, 15, 18, 22, 30, 41, 44.
Lottery: 7 13 22 31 38 45
Latitude 52.52437, longitude 13.41053.
Section 3.2.7.1.5 covers it.
Opening hours 08:00 - 12:00, 13:00 - 17:30
uuid 12345678-1234-1234-1234-123456789012
Pages 101-110, 220-231 and 340-355.
Order 20240312004577 shipped.
ratio 16:9, 4:3, 21:9
Table
12
340
5600
78
Score 999 . 999 . 999 . 999 is a joke.
Room [at] top of stairs.
bracketed [dot] alone
@handle said @other was wrong
1990 1991 1992 1993 1994
Population: 8 336 817 in 2020.
2 + 2 + 2 + 2 + 2 + 2 + 2
The file img_20240312_104512.jpg is missing.
0.125 0.250 0.375 0.500
Invoice 2024/0312/0045 is open.
Area 51, route 66, studio 54, catch 22.
temperatures 21 / 19 / 23 / 25 / 18 / 17
He ran 100 m in 9.58, 200 m in 19.19.
At 10 . 30 we go, at 11 . 45 we return.
ratio (1) (2) (3) (4) (5) (6) (7) (8)
5 6 7
8 9 10
11 12 13
SKU 4006381333931 is a pen.
vote 51 % to 49 %, 50.1 % to 49.9 %
width 1920 height 1080 depth 24
GPS 40.7128, -74.0060 is downtown.
1/2, 3/4, 5/8, 7/16, 9/32
IBAN DE89 3704 0044 0532 0130 00
Bach BWV 1001 - 1006 and 1007 - 1012
"""
